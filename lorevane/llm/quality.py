"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, the character n-grams of each word, and
pairs of neighbouring words (a word followed by itself is one feature of its own, whatever the word). A softmax layer
on the average gives the score. Both are learned by stochastic gradient descent in numpy.

Learning uses at most ``SAMPLE`` labelled documents of each class, picked by a hash of the id among the rows
whose crc32(doc_id) mod 5 is not 0; the output's log-odds are then shifted to the classes' shares among all such rows.
Their features are made in tasks; the driver gets up to ``BUCKETS`` numbers of a document, however long it is.
That bound is the one thing that doesn't cover all rows; scoring reads every text whole. Since the output is linear
in the features, a model is handed to the tasks as one number per feature: ``BUCKETS`` floats, whatever the corpus.

Nulls and edges: a null text is empty; a text without words gets the score of an average of zero; rows with null
labels teach nothing; contradicting labels of an id count as the smaller; with labels of one class only, or none, every
score is the share of label 1 (0.5 without labels). Null and repeated ids are separate documents. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold
from .words import CACHE, mix, raw

BUCKETS = 1 << 18
DIM = 8
GRAMS = (1, 2, 3)
SAMPLE = 2500
EPOCHS = 6
RATE = 0.5
LEAST_DOCS = 4
CUT = 0.3
SEED = 3


def word_features(word: bytes) -> list[int]:
    """The word and its character n-grams, with marks for its begin and end."""
    marked = b"<" + word + b">"
    out = [zlib.crc32(b"w" + word)]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return [x % (BUCKETS - 1) + 1 for x in out]


def pair_features(h: np.ndarray) -> np.ndarray:
    """Bucket of each pair of neighbours; 0 for a word that follows itself."""
    a, b = h[:-1], h[1:]
    pair = mix(a * np.uint64(0x9E3779B97F4A7C15) + b) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return np.where(a == b, 0, pair).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    words = text.split()
    distinct, count = {}, []
    place = [distinct.setdefault(w, len(distinct)) for w in words]
    times = np.bincount(place, minlength=len(distinct)) if words else np.zeros(0, int)
    ids, weight = [], []
    for w, t in zip(distinct, times):
        f = word_features(w)
        ids += f
        weight += [t] * len(f)
    h = np.array([zlib.crc32(w) for w in distinct], np.uint64)[place] if words else np.zeros(0, np.uint64)
    pairs = pair_features(h) if len(h) > 1 else np.zeros(0, np.int64)
    all_ids = np.concatenate([np.array(ids, np.int64), pairs])
    all_weight = np.concatenate([np.array(weight, float), np.ones(len(pairs))])
    key, inverse = np.unique(all_ids, return_inverse=True)
    share = np.bincount(inverse, all_weight, len(key))
    return key.astype(np.int32), (share / max(1.0, share.sum())).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The log-odds that each feature adds at share 1, and the bias. Features in few documents learn nothing."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([k for k, _ in docs]), minlength=BUCKETS)
    used = np.flatnonzero(seen >= min(LEAST_DOCS, len(docs)))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    for i, (k, w) in enumerate(docs):  # in place, so that no second copy is held
        at = place[k]
        docs[i] = at[at >= 0], w[at >= 0]
    emb = (rng.standard_normal((len(used), DIM)) / DIM).astype(np.float32)
    out, bias = (rng.standard_normal((DIM, 2)) / DIM).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(len(used), 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    batch, steps = 16, epochs * -(-len(docs) // 16)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            idx = np.concatenate([docs[i][0] for i in pick])
            share = np.concatenate([docs[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
            lines, local = np.unique(idx, return_inverse=True)
            m = np.zeros((len(pick), len(lines)), np.float32)
            m[of, local] = share
            rows = emb[lines]
            hidden = m @ rows
            logit = hidden @ out + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            lr = rate * (1 - step / steps)
            step += 1
            d_rows = m.T @ (p @ out.T)
            d_out, d_bias = hidden.T @ p, p.sum(axis=0)
            g_emb[lines] += (d_rows * d_rows).mean(axis=1)
            g_out += d_out * d_out
            g_bias += d_bias * d_bias
            emb[lines] = rows - lr * d_rows / np.sqrt(g_emb[lines])[:, None]
            out -= lr * d_out / np.sqrt(g_out)
            bias -= lr * d_bias / np.sqrt(g_bias)
    odds = np.zeros(BUCKETS, np.float32)
    odds[used] = emb @ (out[:, 1] - out[:, 0])
    return odds, float(bias[1] - bias[0])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


#: What a byte does to a crc32.
_CRC = _crc_table()


class Scorer(dict):
    """Score of a text; remembers what each word adds."""

    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias = odds.astype(np.float64), bias
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.sum, self.n, self.hash = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.n):
            self.sum, self.n, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sum, self.n, self.hash))
        f = word_features(word)
        odds = self.odds
        self.sum[i], self.n[i], self.hash[i] = sum(odds[x] for x in f), len(f), zlib.crc32(word)
        self[word] = i
        return i

    def learn(self, words: set[bytes]) -> None:
        """What many words add, at once; as ``__missing__``, in the same order of adding."""
        if len(self) + len(words) > CACHE:
            self.reset()
        new = [w for w in words if w not in self]
        if not new:
            return
        n = len(new)
        size = np.fromiter(map(len, new), np.int64, n) + 2
        b = np.frombuffer(b"".join([b"<" + w + b">" for w in new]), np.uint8).astype(np.uint32)
        of = np.repeat(np.arange(n), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(b))  # bytes of the word from here on
        codes, places = [np.fromiter((zlib.crc32(b"w" + w) for w in new), np.int64, n)], [np.arange(n)]
        state = np.full(len(b), 0xFFFFFFFF, np.uint32)
        for k in range(max(GRAMS)):
            state = state[: len(b) - k]
            state = _CRC[(state ^ b[k:]) & 255] ^ (state >> 8)
            if k + 1 in GRAMS:
                own = left[: len(state)] > k
                codes.append((state ^ np.uint32(0xFFFFFFFF))[own].astype(np.int64))
                places.append(of[: len(state)][own])
        code, place = np.concatenate(codes), np.concatenate(places)
        at = len(self)
        if at + n > len(self.n):
            more = max(at + n - len(self.n), len(self.n))
            self.sum, self.n, self.hash = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.sum, self.n, self.hash))
        self.sum[at : at + n] = np.bincount(place, self.odds[code % (BUCKETS - 1) + 1], n)
        self.n[at : at + n] = np.bincount(place, minlength=n)
        self.hash[at : at + n] = np.fromiter(map(zlib.crc32, new), np.uint64, n)
        self.update(zip(new, range(at, at + n)))

    def many(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50]
            self.learn(set().union(*(t.split() for t in part)))
            out += map(self, part)
        return out

    def __call__(self, text: bytes) -> float:
        words = text.split()
        if len(self) > CACHE:
            self.reset()
        if not words:
            return self.of(0.0)
        i = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total, n = self.sum[i].sum(), self.n[i].sum()
        if len(i) > 1:
            total += self.odds[pair_features(self.hash[i])].sum()
            n += len(i) - 1
        return self.of(total / n)

    def of(self, odds: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(odds + self.bias, -700, 700))))


def _featured(batches):
    """(doc_id, y, text) to features. What the driver gets of a document has no more entries than there are buckets."""
    for b in batches:
        for at in range(0, b.num_rows, 100):
            part = b.slice(at, 100)
            ids, shares = zip(*map(features, raw(part.column(2))))
            yield pa.record_batch({
                "doc_id": part.column(0).cast(pa.int64()), "y": part.column(1).cast(pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32())), "shares": pa.array(shares, pa.list_(pa.float32()))})


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, mod: int = 5, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from the labelled rows outside fold 0."""
    own = labels.where((fold(F.col("doc_id"), mod) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.min("quality").alias("y")).where("y in (0, 1)")
    n = {int(r["y"]): int(r["count"]) for r in own.groupBy("y").count().collect()}
    prior = np.log(max(n.get(1, 0), 0.5) / max(n.get(0, 0), 0.5))
    if len(n) < 2:
        return np.zeros(BUCKETS, np.float32), float(prior if n else 0.0)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(sample / n[1])).otherwise(F.lit(sample / n[0]))
    # About ``sample`` ids of each class: small enough to go to every task.
    picked = own.where(u < share)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # Of several texts with one id, always the same.
    some = some.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    got = some.mapInArrow(_featured, "doc_id long, y int, ids array<int>, shares array<float>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return np.zeros(BUCKETS, np.float32), float(prior)
    y = got["y"].to_numpy().astype(np.int64)
    if len(set(y)) < 2:
        return np.zeros(BUCKETS, np.float32), float(prior)
    odds, bias = train([(k.values.to_numpy(), w.values.to_numpy()) for k, w in zip(got["ids"], got["shares"])], y)
    return odds, bias + float(prior - np.log(y.sum() / (len(y) - y.sum())))


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.record_batch([part.column(0), pa.array(scorer.many(raw(part.column(1))), pa.float64())], schema=schema)

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, cut: float = CUT) -> DataFrame:
    """The documents whose score is at least ``cut``, with all their columns."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    names = docs.columns

    def run(batches):
        scorer = Scorer(*model.value)
        at = names.index("text")
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield part.filter(pa.array([x >= cut for x in scorer.many(raw(part.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
