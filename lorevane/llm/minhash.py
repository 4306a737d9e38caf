"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: for each of up to 2t rounds the elements of a set are placed. In the first t rounds every element goes to a
bin of its own hash, and a bin keeps the smallest hash of the first round that reached it; in the rounds after,
bin after bin takes the minimum over all elements, so every one of the t bins is filled. Most sets fill all bins in two
or three rounds; agreement over bins estimates the Jaccard similarity with the concentration of independent bins.

Candidates: bands of bins, ``BANDS`` of ``ROWS`` at 0.85. At the threshold s a pair is missed with chance (1 - s**rows)**bands, 5e-5
at 0.85; for another threshold ``banding`` takes as many bands of ``ROWS`` as keep that chance (33 at 0.80). Texts with equal
word sequences are one member throughout. Two ways, by the number of members in a band's bucket:

* up to ``SMALL``: each two members are a pair of ids, told apart once over all bands. A pair whose set sizes rule the threshold out
  goes, and the others are verified on full sets, all pairs of one member together. Chance collisions cost one pair each and
  don't chain.
* larger buckets, which near copies of one text fill: each adds edges from its members to its smallest one, and the components of
  these edges are groups. Within a group every two members are compared on full sets, in tiles of bounded size, so a group of any
  size is exact; a tile returns a spanning forest of its links instead of the pairs. Pairs within a group are left to it.

Only texts of candidates are moved. What a task holds is bounded by words: ``TASK_WORDS`` in all, about, or a few texts.

Nulls and edges: a null text, one without words and an empty one have an empty set and link with nothing (its own id is its
component); other rows with the same id are one node, whatever their texts; a null id is linked with nothing (component_id null,
kept false); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import components, sieve, sifted, tiles
from .embed_dedup import spanning
from .words import Hashes, mix, raw, split

BINS, BANDS, ROWS = 126, 21, 6
SMALL = 32
TILE, TASK_WORDS = 96, 400_000
COLUMNS = 8192


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for which a pair at the threshold is missed no more often than one at 0.85 by ``BANDS`` of ``ROWS``, but
    ``BANDS`` at least. Below 0.5 rows are fewer, so that bands stay few."""
    rows = ROWS if percent >= 50 else 2 if percent >= 20 else 1
    s = min(max(percent, 1), 99) / 100
    miss = BANDS * math.log1p(-(0.85**ROWS))
    return max(BANDS, math.ceil(miss / math.log1p(-(s**rows)))), rows


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashed shingles of hashed words; with fewer words than ``size``, the whole sequence."""
    if not len(words):
        return words
    size_ = min(size, len(words))
    h = np.full(len(words) - size_ + 1, size_, np.uint64)
    for i in range(size_):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(h)])
    return np.unique(h)


def sketch(elements: np.ndarray, t: int = BINS) -> np.ndarray:
    """t bins, all filled; elements: at least one distinct 64-bit hash."""
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            new = np.full(t, top, np.uint64)
            np.minimum.at(new, (h % np.uint64(t)).astype(np.int64), h)
            got = empty & (new < top)
            out[got] = mix(new[got] + np.uint64(i))
            empty &= ~got
        elif empty[i - t]:
            out[i - t] = mix(h.min(keepdims=True) + np.uint64(i))[0]
            empty[i - t] = False
        if not empty.any():
            break
    return out


def bands(s: np.ndarray, n: int, rows: int) -> np.ndarray:
    h = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[j : n * rows : rows])
    return h.view(np.int64)


def _sketches(words: int, percent: int):
    n_bands, n_rows = banding(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        hashes = Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ns, marks, keys = [], [], []
                for text in raw(part.column(2)):
                    w = split(text)
                    s = shingles(hashes.of(w), words)
                    ns.append(len(s))
                    marks.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
                    keys.append(bands(sketch(s, n_bands * n_rows), n_bands, n_rows) if w else None)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, schema.field("bands").type)], schema=schema)

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Symmetric matrix of the pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        common = np.array([[size[0], both], [both, size[1]]])
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size)
        value, place, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count[place] > 1  # what only one set has adds to no intersection
        place, owner = place[shared], owner[shared]
        column = np.unique(place, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((n, n), np.float64)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (start, start + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[lo:hi], column[lo:hi] - start] = 1
            common += m @ m.T
        common = common.astype(np.int64)
    out = (size > 0)[:, None] & (100 * common >= percent * (size[:, None] + size[None, :] - common))
    np.fill_diagonal(out, False)
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(t: pa.Table, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Members in order, each once, and their sets."""
    hashes = Hashes()
    ids, first = np.unique(t["nid"].to_numpy(), return_index=True)
    texts = t["text"].combine_chunks()
    return ids, [shingles(hashes.of(split(raw(texts.slice(int(i), 1))[0])), words) for i in first]


def _tile(words: int, percent: int):
    """Every two members of a tile."""

    def task(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return _LINKS.empty_table()
        ids, sets = _sets(t, words)
        label = spanning(linked(sets, percent))
        moved = label != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]}, schema=_LINKS)

    return task


def _one_to_many(words: int, percent: int):
    """One member, a, with each of its others."""

    def task(t: pa.Table) -> pa.Table:
        ids, sets = _sets(t, words)
        a = t["a"][0].as_py()
        own = sets[int(np.searchsorted(ids, a))]
        both = np.array([len(np.intersect1d(own, s, assume_unique=True)) for s in sets], np.int64)
        size = np.array([len(s) for s in sets], np.int64)
        hit = (100 * both >= percent * (len(own) + size - both)) & (ids != a)
        return pa.table({"a": np.full(int(hit.sum()), a), "b": ids[hit]}, schema=_LINKS)

    return task


def links(scratch: Scratch, docs: DataFrame, reps: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Links (a, b) of members ``reps`` (nid, n, doc_id, t, bands): all pairs that collide and are alike, or paths of such."""
    # Written, since it is read four times: every band is made into a row once.
    keyed = scratch.keep(reps.select("nid", "n", F.explode("bands").alias("key")))
    full = keyed.groupBy("key").agg(F.min("nid").alias("least"), F.max("nid").alias("most"), F.count(F.lit(1)).alias("m")).where("least < most")
    full = scratch.keep(full.select("key", "least", "m"))
    large = keyed.join(full.where(F.col("m") > SMALL), "key").select(F.col("nid").alias("a"), F.col("least").alias("b"))
    groups = components(scratch, large)
    few = keyed.join(full.where(F.col("m") <= SMALL).select("key"), "key")
    other = few.select("key", F.col("nid").alias("b"), F.col("n").alias("n_b"))
    pairs = few.select("key", F.col("nid").alias("a"), F.col("n").alias("n_a")).join(other, "key").where("a < b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = scratch.keep(pairs.where(fits).select("a", "b", "n_b").distinct())
    in_a, in_b = (groups.select(F.col("node").alias(x), F.col("component").alias(f"g{x}")) for x in "ab")
    pairs = scratch.keep(pairs.join(in_a, "a", "left").join(in_b, "b", "left").where("ga is null or gb is null or ga <> gb").select("a", "b", "n_b"))
    some = groups.select(F.col("node").alias("nid")).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("nid"))).distinct()
    some = scratch.keep(reps.join(some, "nid").select("nid", "n", F.col("doc_id").alias("id_"), F.col("t").alias("t_")))
    # Only texts of candidates, and a few others, are moved to them; by the same plan whatever the number of candidates.
    pass_ = sieve(some.select(F.xxhash64("id_", "t_").alias("h")))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("d_"), F.xxhash64("text").alias("x_"), "text")
    own = sifted(scratch.spark, own.select(F.xxhash64("d_", "x_").alias("h"), "d_", "x_", "text"), pass_)
    texts = own.join(some.hint("merge"), (F.col("d_") == F.col("id_")) & (F.col("x_") == F.col("t_")))
    texts = scratch.keep(texts.groupBy("nid").agg(F.first("text").alias("text")))
    # Pairs: the others of each a in parts of about as many words.
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / F.lit(TASK_WORDS)).cast("long").alias("parts"))
    pairs = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("nid"))
    pairs = scratch.keep(pairs.unionByName(pairs.select("a", "part", F.col("a").alias("nid")).distinct()))
    one = pairs.join(texts.hint("merge"), "nid").groupBy("a", "part").applyInArrow(_one_to_many(words, percent), "a long, b long")
    # Groups: tiles of so many members that their words stay about the same.
    sizes = groups.join(some.select(F.col("nid").alias("node"), "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("size") / TILE), F.ceil(2 * F.col("words") / TASK_WORDS)).cast("long").alias("chunks"))
    members = scratch.keep(groups.join(sizes, "component").select(F.col("node").alias("nid"), F.col("component").alias("grp"), "chunks"))
    part = tiles(members.join(texts.hint("merge"), "nid"), "grp", F.col("chunks"), F.col("nid"), 1)
    all_ = part.groupBy("grp", "ci", "cj").applyInArrow(_tile(words, percent), "a long, b long")
    return scratch.keep(one.unionByName(all_))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = scratch.keep(rows.mapInArrow(_sketches(words, percent), "doc_id long, t long, n long, mark binary, bands array<long>"))
    whole = rows.where("mark is not null and doc_id is not null")
    reps = whole.groupBy("mark").agg(F.min(F.struct("doc_id", "t")).alias("x"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    reps = scratch.keep(reps.select(F.monotonically_increasing_id().alias("nid"), "mark", F.col("x.doc_id").alias("doc_id"), F.col("x.t").alias("t"), "n", "bands"))
    found = links(scratch, docs, reps.select("nid", "doc_id", "t", "n", "bands"), words=words, percent=percent)
    # Rows that share an id are one node, whatever their texts.
    ids = whole.select("doc_id", "mark").distinct().join(reps.select("mark", "nid"), "mark")
    again = scratch.keep(ids.groupBy("doc_id").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a < z").select("doc_id", "a"))
    same = ids.join(again, "doc_id").select("a", F.col("nid").alias("b"))
    comp = components(scratch, found.unionByName(same))
    named = reps.select("mark", "nid", "doc_id").join(comp.withColumnRenamed("node", "nid"), "nid", "left").select("mark", "doc_id", F.coalesce("component", "nid").alias("g"))
    least = named.groupBy("g").agg(F.min("doc_id").alias("c"))
    named = scratch.keep(named.join(least, "g").select("mark", "c"))
    out = rows.select("doc_id", "n", "mark").join(named, "mark", "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep(spark: SparkSession, docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group. Rows that link with nothing, null ids and texts without words all
    stay; of rows with one id, those with equal texts count as copies and one stays."""
    scratch = Scratch(spark, "minhash")
    found = near_duplicates(spark, docs, words=words, percent=percent)
    gone = scratch.keep(found.where("doc_id is not null and n_shingles > 0 and not kept").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = scratch.keep(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
