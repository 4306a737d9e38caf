"""Language-model scoring with a weighted backoff automaton.

Tokens are lower-cased (A-Z) words and one end per document. The unigram level is (c + 0.5) / (N + 0.5 * (V + 1)),
with the count c of every word of the training documents. N-grams up to ``ORDER`` over all words are counted over all training
documents too; those seen ``LEAST`` times or more, at any size of the corpus, are arcs, with interpolated absolute discounting:
(c - DISCOUNT) / c(context), plus what the discount and the rare n-grams leave of the context times the next shorter context's
probability. That rest is the weight of the context's failure arc, so each state's probabilities sum to 1.

The automaton: states are contexts with arcs; an arc has a log10 probability and leads to the longest state that ends what
was read; a failure arc has a backoff weight. A document is read from left to right: while the state has no arc for the token, take
the failure arc and add its weight; then take the arc. ``Automaton`` does that in memory, for a small vocabulary.

For a corpus the automaton is dealt out, and grows with the corpus; nothing is broadcast, no word or n-gram left out:

1. Documents become chunks of about ``CHUNK`` tokens: the chunk's word hashes and its tokens as places among them, packed. Texts are
   split once, many at a time.
2. Each chunk asks for its distinct n-grams: sorted 64-bit keys with their counts in its training documents, dealt to buckets by
   range, one packed row a bucket. A bucket adds up and answers each chunk with the totals in the order asked, and names one
   chunk as owner of each arc. An n-gram comes once from a chunk however often it stands there, so no key is hot.
   From order 3 on it asks only for those whose first and last n - 1 words were both seen ``least`` times or more: each time the
   n-gram stands in the training documents, both of these do too, so no other can be an arc.
3. Owners send what their arcs take of each context, added up within the chunk; chunks ask for their contexts in the same way
   and are answered with the sums, which give the failure arcs' weights. The n-grams of the next order are asked for in the same pass.
4. A chunk then holds all arcs and failure arcs that its documents can meet, and reads them: the state before a token is the longest
   state among its last words, so all tokens take their failure arcs in step, longest context first.

Nulls and edges: a null text is empty and has just its end; an empty training set gives c = 0, N = 0, V = 0 and the
score 0 for each token (log10 of 1, the unknown word's share); null and repeated ids are separate documents; a very long text is
one chunk of its own size; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import fold
from .words import mix

LEAST = 2
ORDER = 3
DISCOUNT = 0.75
END = b"\n"  # no word can be this
#: Tokens of a chunk, about, and bytes of texts that are split at once.
CHUNK, PIECE = 1 << 21, 1 << 22
#: Tokens for which there is a bucket of keys. Each chunk sends a packet to each bucket, so the packets are as many as the square of the corpus by
#: CHUNK * BUCKET: these are as large as a task's memory allows, for packets of some thousand keys at 1 GB and still hundreds at 30 GB.
BUCKET = 1 << 22
#: N-grams of a chunk that are read at once.
STEP = 1 << 18
#: Bytes from which a packet is squeezed on its own.
SQUEEZE = 512


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and the end; each token as a place among them, with an end after each text; tokens of each text.
    Arrow parts texts at the same bytes as bytes.split(), but leaves empty words before the first space and after the last."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = found.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    token, text = flat.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
    some = np.fromiter(map(bool, words), bool, len(words))[token]
    token, size = token[some], np.bincount(text[some], minlength=len(texts)) + 1
    inner = np.ones(size.sum(), bool)
    inner[np.cumsum(size) - 1] = False
    out = np.full(len(inner), len(words), np.int32)
    out[inner] = token
    return np.fromiter(map(xxhash.xxh64_intdigest, [*words, END]), np.uint64, len(words) + 1), out, size


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; some place at which each stands; each key's place among the distinct ones. Unlike np.unique it needs no
    stable sort."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], order[new], place


_SQUEEZE, _SPREAD = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes, by planes of equal rank, squeezed if they are many. Planes that are 0 in all of them are left out; the
    first byte says how many there are, and 16 more if they are squeezed."""
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = (x.astype(np.uint8) if k == 1 else x.view(np.uint8).reshape(-1, x.itemsize)[:, :k].T).tobytes()
    return bytes([k]) + planes if len(planes) < SQUEEZE else bytes([k + 16]) + _SQUEEZE.compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    k, rest = b[0] & 15, memoryview(b)[1:]
    planes = np.frombuffer(_SPREAD.decompress(rest) if b[0] & 16 else rest, np.uint8)
    if k == 1:
        return planes.astype(dtype)
    out = np.zeros((len(planes) // k, np.dtype(dtype).itemsize), np.uint8)
    out[:, :k] = planes.reshape(k, -1).T
    return out.view(dtype).ravel()


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys, as steps."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(b: bytes, least: int = 0) -> np.ndarray:
    x = unpack(b, np.uint64)
    x[:1] += np.uint64(least)
    return np.cumsum(x, out=x)


def join(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Key of n-grams, by the keys of their first and their last n - 1 words."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(n))


_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("words", pa.binary()),
    ("tokens", pa.binary()), ("n", pa.int64())])


def _chunks(batches, most: int = CHUNK, piece: int = PIECE):
    """(row, doc_id, held, text) to chunks. A chunk's number is that of its first row."""
    parts, rows = [], []

    def out():
        hashes, tokens, n = [], [], 0
        for h, token in parts:
            used = np.flatnonzero(np.bincount(token, minlength=len(h)))
            place = np.empty(len(h), np.int64)
            place[used] = np.arange(n, n + len(used))
            hashes.append(h[used])
            tokens.append(place[token])
            n += len(used)
        vocabulary, _, place = distinct(np.concatenate(hashes))
        token = place[np.concatenate(tokens)]
        first, ids, held, sizes = rows[0][0], *zip(*(r[1:] for r in rows))
        parts.clear()
        rows.clear()
        return pa.record_batch([pa.array([x], t) for x, t in zip((first, ids, held, sizes, pack_keys(vocabulary), pack(token.astype(np.uint32)), len(token)), _CHUNKS.types)], schema=_CHUNKS)

    n = 0
    for b in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(b.column(3)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(length, piece + (length[i - 1] if i else 0), "right")))
            h, token, size = words_of(b.column(3).slice(i, j - i))
            s = e = 0  # of the piece's tokens, those that no chunk has yet
            for *row, k in zip(*(b.column(c).slice(i, j - i).to_pylist() for c in range(3)), size.tolist()):
                if n and n + k > most:
                    if e > s:
                        parts.append((h, token[s:e]))
                    yield out()
                    n, s = 0, e
                rows.append((*row, k))
                n, e = n + k, e + k
            parts.append((h, token[s:e]))
            i = j
    if rows:
        yield out()


class Chunk:
    """A chunk's documents and its distinct n-grams, in the order of their keys."""

    def __init__(self, words: bytes, tokens: bytes, sizes: list[int], held: list[bool]):
        self.sizes, self.held = np.array(sizes, np.int64), np.array(held, bool)
        vocabulary, token = unpack_keys(words), unpack(tokens, np.uint32).view(np.int32)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.train = ~self.held[self.doc]
        self.edge = np.zeros(len(token), bool)
        self.edge[np.cumsum(self.sizes) - 1] = True  # the end closes a document
        every = np.arange(len(token), dtype=np.int32)
        #: By order: keys; counts in training documents; first tokens of all n-grams, and of those that are in keys; each token's n-gram, as
        #: a place in keys or -1; each key's context, as a place in the keys of the order below.
        self.keys, self.count, self.all, self.start, self.place, self.context = {1: vocabulary}, {1: np.bincount(token[self.train], minlength=len(vocabulary)).astype(np.int32)}, {1: every}, {1: every}, {1: token}, {}

    def grow(self, n: int, often: np.ndarray | None = None) -> None:
        """Adds the n-grams of an order; ``often``: only those whose first and last n - 1 words are among these keys."""
        below, every = self.place[n - 1], self.all[n - 1]
        every = every[~self.edge[every + n - 2]]
        self.all[n] = at = every
        if often is not None:
            keep = np.append(often, False)[below]
            at = every[keep[every] & keep[every + 1]]
        g = self.keys[n - 1]
        self.start[n] = at
        self.keys[n], some, place = distinct(join(g[below[at]], g[below[at + 1]], n))
        self.context[n] = below[at[some]]
        self.count[n] = np.bincount(place[self.train[at]], minlength=len(some)).astype(np.int32)
        self.place[n] = np.full(len(below), -1, np.int32)
        self.place[n][at] = place


def _slices(keys: np.ndarray, bits: int):
    """(bucket, from, to, packed steps from the bucket's least key) of sorted keys, by their first bits."""
    bucket = keys >> np.uint64(64 - bits)
    cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
    step = np.diff(keys, prepend=np.uint64(0))
    step[cut] = keys[cut] - (bucket[cut] << np.uint64(64 - bits))
    for k, s, e in zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        yield k, s, e, pack(step[s:e])


def _columns(t: pa.Table, *names: str) -> list[list]:
    return [t[x].to_numpy().tolist() for x in names]


_ASKS = pa.schema([("bucket", pa.int64()), ("o", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("count", pa.binary()), ("arcs", pa.binary())])
_REPLIES = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("o", pa.int32()), ("bucket", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("total", pa.int64()), ("types", pa.int64())])


def _spelled(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _asked(chunk: int, c: Chunk, o: int, bits: int) -> list[tuple]:
    return [(k, o, chunk, keys, pack(c.count[o][s:e]), None) for k, s, e, keys in _slices(c.keys[o], bits)]


def _ask(order: int, bits: int):
    """Chunks to what they ask about words and, if there are longer n-grams, pairs."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r, c = _of(b.slice(i, 1))
                for o in range(1, min(2, order) + 1):
                    if o > 1:
                        c.grow(o)
                    rows = _asked(r["chunk"], c, o, bits)
                    if rows:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _ASKS.types)], schema=_ASKS)

    return run


def _add(least: int, bits: int):
    """All that is asked of one bucket to the replies: totals, doubled, and 1 more if the chunk owns the arc."""

    def task(t: pa.Table) -> pa.Table:
        o, bucket = t["o"][0].as_py(), t["bucket"][0].as_py()
        chunks, keys, counts = _columns(t.sort_by("chunk"), "chunk", "keys", "count")
        keys = [unpack_keys(x, bucket << 64 - bits) for x in keys]
        ends = np.cumsum([len(x) for x in keys]).tolist()
        own = np.concatenate([unpack(x, np.int64) for x in counts])
        _, at, place = distinct(np.concatenate(keys))
        del keys
        total = np.bincount(place, own, len(at)).astype(np.int64)
        mine = np.flatnonzero((own > 0) & (total >= least)[place])
        last = np.full(len(at), -1)
        last[place[mine]] = mine
        reply = 2 * total[place]
        reply[last[last >= 0]] += 1
        sums = [(int(total.sum()), int((total > 0).sum()))] + [(0, 0)] * len(chunks)
        rows = [(c, 1, o, bucket, pack(reply[s:e]), None, *n) for c, s, e, n in zip(chunks, [0, *ends], ends, sums)]
        return pa.table([pa.array(x, y) for x, y in zip(zip(*rows), _REPLIES.types)], schema=_REPLIES)

    return task


class Replies:
    """What a chunk was answered, by kind and order, put together in the order asked."""

    def __init__(self, t: pa.Table):
        kind, o, bucket, first, second = _columns(t, "kind", "o", "bucket", "first", "second")
        self.rows: dict[tuple[int, int], list[int]] = {}
        for i in np.lexsort((bucket, o, kind)).tolist():
            self.rows.setdefault((kind[i], o[i]), []).append(i)
        self.columns = {"first": first, "second": second}

    def numbers(self, kind: int, o: int, column: str, n: int) -> np.ndarray:
        found = [unpack(self.columns[column][i], np.int64) for i in self.rows.get((kind, o), ())]
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(out) != n:
            raise ValueError(f"{len(out)} replies to {n} keys of order {o}")
        return out

    def totals(self, o: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all n-grams asked about: their totals, and whether the chunk owns the arc."""
        found = self.numbers(1, o, "first", n)
        return found >> 1, (found & 1).astype(bool)


def _of(t: pa.Table | pa.RecordBatch) -> tuple[dict, Chunk]:
    r = t.to_pylist()[0]
    return r, Chunk(r["words"], r["tokens"], r["size"], r["held"])


def _grown(c: Chunk, found: Replies, order: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The replies about a chunk's n-grams, which grow up to an order as they were asked for, by order: totals, and owned arcs."""
    got = {}
    for o in range(1, order + 1):
        if o > 1:
            c.grow(o, got[o - 1][0] >= least if o > 2 else None)
        got[o] = found.totals(o, len(c.keys[o]))
    return got


def _contexts(o: int, order: int, least: int, bits: int):
    """A chunk with its totals to what its own arcs of one order take of their contexts, and to the contexts that it asks about; also
    to what it asks about n-grams of the next order."""

    def task(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _ASKS.empty_table()
        r, c = _of(chunk)
        got = _grown(c, Replies(replies), o, least)
        (total, own), below = got[o], c.keys[o - 1]
        arc = np.flatnonzero(own)
        n = np.bincount(c.context[o][arc], minlength=len(below))
        taken = np.bincount(c.context[o][arc], total[arc], len(below)).astype(np.int64)
        some = np.flatnonzero(n)
        rows = [(k, o, -1, keys, pack(taken[some[s:e]]), pack(n[some[s:e]])) for k, s, e, keys in _slices(below[some], bits)]
        ask = below[got[o - 1][0] >= least]
        rows += [(k, o, r["chunk"], keys, None, None) for k, _, _, keys in _slices(ask, bits)]
        if o < order:
            c.grow(o + 1, total >= least)
            rows += _asked(r["chunk"], c, o + 1, bits)
        return pa.table([pa.array(x, y) for x, y in zip(zip(*rows), _ASKS.types)], schema=_ASKS) if rows else _ASKS.empty_table()

    return task


def _rest(bits: int):
    """What is known of one bucket of contexts to the replies: counts that arcs take, and how many arcs. Owners' rows have no chunk."""

    def task(t: pa.Table) -> pa.Table:
        o, bucket = t["o"][0].as_py(), t["bucket"][0].as_py()
        chunks, asked, *known = _columns(t, "chunk", "keys", "count", "arcs")
        have = [i for i, c in enumerate(chunks) if c < 0]
        keys, _, place = distinct(np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(asked[i], bucket << 64 - bits) for i in have)]))
        sums = [np.append(np.bincount(place, np.concatenate([np.zeros(0, np.int64), *(unpack(x[i], np.int64) for i in have)]), len(keys)).astype(np.int64), 0) for x in known]
        out = []
        for c, x in zip(chunks, asked):
            if c >= 0:
                ask = unpack_keys(x, bucket << 64 - bits)
                at = np.searchsorted(keys, ask)
                at[np.append(keys, np.uint64(0))[at] != ask] = len(keys)
                out.append((c, 2, o, bucket, *(pack(s[at]) for s in sums), 0, 0))
        return pa.table([pa.array(x, y) for x, y in zip(zip(*out), _REPLIES.types)], schema=_REPLIES) if out else _REPLIES.empty_table()

    return task


def _answer(o: int, least: int, bits: int):
    """One bucket of contexts of order ``o``, or of n-grams of the next, to the replies."""
    rest, add = _rest(bits), _add(least, bits)
    return lambda t: (rest if t["o"][0].as_py() == o else add)(t)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _read(order: int, least: int, discount: float, n: int, v: int):
    """A chunk with its totals and contexts to its documents' scores."""
    z = n + 0.5 * (v + 1)
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _SCORES.split(", ")]

    def task(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        (r, c), found = _of(chunk), Replies(replies)
        got = _grown(c, found, order, least)
        c.keys, c.count = {}, {}  # only asked with
        below = got[1][0]
        known = (below > 0)[c.place[1]]
        p = ((below + 0.5) / z)[c.place[1]]
        base = np.bincount(c.doc, np.log10(p), len(c.sizes))
        for o in range(2, order + 1):
            total = got[o][0]
            asked = below >= least
            taken, arcs = (np.zeros(len(below)) for _ in range(2))
            taken[asked], arcs[asked] = (found.numbers(2, o, x, int(asked.sum())) for x in ("first", "second"))
            of = np.maximum(below, 1)
            fail = np.append(1 - (taken - discount * arcs) / of, 1.0)  # 1 for a context that is no state
            arc = np.where(total >= least, (total - discount) / of[c.context[o]], 0.0)
            for i in range(0, len(c.all[o]), STEP):
                at = c.all[o][i : i + STEP]
                p[at + o - 1] *= fail[c.place[o - 1][at]]
            for i in range(0, len(c.start[o]), STEP):
                at = c.start[o][i : i + STEP]
                p[at + o - 1] += arc[c.place[o][at]]
            below = total
        score = np.bincount(c.doc, np.log10(p, out=p), len(c.sizes))
        seen = np.bincount(c.doc[known], minlength=len(c.sizes))
        columns = (r["doc_id"], r["held"], c.sizes, seen, base, score)
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    return task


class Automaton:
    """The automaton in memory: states are tuples of words, failure arcs drop the first word. For small corpora and for tests."""

    def __init__(self, documents: list[list[bytes]], order: int = ORDER, least: int = LEAST, discount: float = DISCOUNT):
        """documents: the tokens of the training documents, each with its end."""
        count: dict[tuple, int] = {}
        for d in documents:
            for n in range(1, order + 1):
                for i in range(len(d) - n + 1):
                    g = tuple(d[i : i + n])
                    count[g] = count.get(g, 0) + 1
        words = {g: c for g, c in count.items() if len(g) == 1}
        self.z, self.words = sum(words.values()) + 0.5 * (len(words) + 1), words
        self.order = order
        self.fail: dict[tuple, float] = {}
        self.arcs: dict[tuple, float] = {}
        for n in range(2, order + 1):
            arcs = {g: c for g, c in count.items() if len(g) == n and c >= least}
            taken: dict[tuple, float] = {}
            for g, c in arcs.items():
                taken[g[:-1]] = taken.get(g[:-1], 0.0) + c - discount
            for a, t in taken.items():
                self.fail[a] = float(np.log10(1 - t / count[a]))
            for g, c in arcs.items():
                self.arcs[g] = float(np.log10((c - discount) / count[g[:-1]] + 10 ** (self.fail[g[:-1]] + self.step(g[1:-1], g[-1])[0])))

    def after(self, history: tuple) -> tuple:
        """The longest state that the history ends with."""
        history = history[-(self.order - 1) :] if self.order > 1 else ()
        while history and history not in self.fail:
            history = history[1:]
        return history

    def step(self, state: tuple, word: bytes) -> tuple[float, tuple]:
        """Log-probability of a word, and the state after it."""
        weight, at = 0.0, state
        while at and (*at, word) not in self.arcs:
            weight += self.fail.get(at, 0.0)
            at = at[1:]
        own = self.arcs[(*at, word)] if at else float(np.log10((self.words.get((word,), 0) + 0.5) / self.z))
        return weight + own, self.after((*state, word))

    def read(self, tokens: list[bytes]) -> float:
        """One traversal from left to right."""
        total, state = 0.0, ()
        for w in tokens:
            p, state = self.step(state, w)
            total += p
        return total


def score(
    spark: SparkSession, docs: DataFrame, *, mod: int = 5, out: int = 1, order: int = ORDER, least: int = LEAST, discount: float = DISCOUNT, chunk: int = CHUNK, bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(spark, "lm")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), mod) == out).alias("held"), "text")
    chunks = scratch.keep(d.mapInArrow(lambda batches: _chunks(batches, chunk), "chunk long, doc_id array<long>, held array<boolean>, size array<long>, words binary, tokens binary, n long"))
    tokens = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, int(tokens // bucket).bit_length())
    asks = chunks.select("chunk", "held", "size", "words", "tokens").mapInArrow(_ask(order, bits), _spelled(_ASKS))
    every = scratch.keep(asks.groupBy("o", "bucket").applyInArrow(_add(least, bits), _spelled(_REPLIES)))
    n, v = every.where("o = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    both = lambda right, task, schema: chunks.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(task, schema)
    for o in range(2, order + 1):
        contexts = both(every.where((F.col("kind") == 1) & (F.col("o") <= o)), _contexts(o, order, least, bits), _spelled(_ASKS))
        every = every.unionByName(scratch.keep(contexts.groupBy("o", "bucket").applyInArrow(_answer(o, least, bits), _spelled(_REPLIES))))
    read = both(every, _read(order, least, discount, int(n), int(v)), _SCORES)
    return read.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
