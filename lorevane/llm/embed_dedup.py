"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Rows with the same label are linked at cosine >= ``threshold``. Normalised vectors at that cosine lie within
d = sqrt(2 - 2 * threshold); a table's key is ``k`` values floor((a . v + b) / WIDTH) with Gaussian a, so near
vectors share all of them with a known probability. ``k`` follows the size of the largest label, so that a bucket
holds few unrelated rows at any size, and the number of tables follows k for a recall of ``RECALL`` at the
threshold (more above it). Projections are computed in whole numbers, so keys never depend on how rows are batched.

Equal vectors are one row with a multiplicity. A bucket of up to ``TILE`` rows is one tile, and tasks take many such buckets at once;
a larger one is worked on in tiles of bounded size that together hold every pair in it. A tile counts links instead of returning pairs, and counts a pair only in the first table in which
its rows share a key. Out come link counts per vector and, for components, edges from each vector to the smallest
vector of its linked group in the tile. So neither a large bucket nor a large group makes a large task or row count.

Nulls and edges: a null label, or a vector that is null, empty, zero or holds null or non-finite components, links
with nothing (n_links 0, its own component); vectors of different lengths do not link; a null vec_id counts as a vector
but has a null component; repeated ids are separate vectors of one node; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import components, tiles
from .topk import matrix

THRESHOLD = 0.93
WIDTH = 2.0
RECALL = 0.9995
SEED = 11
TILE = 384
#: Rows of small buckets that are handed to one task, about.
BATCH = 8192
GRID = 1 << 20


def collide(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance share one quantised projection."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables, for ``n`` rows in the largest label."""
    far = collide(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 65) / 64) / -math.log(far)))
    near = collide(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near))


def keys_of(unit: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One 64-bit key for each row and table; unit: rows of length 1."""
    r = np.random.default_rng(seed)
    a = np.round(r.standard_normal((unit.shape[1], tables * k)) * 65536)
    b = np.floor(r.random(tables * k) * WIDTH * GRID * 65536)
    # Whole numbers below 2**53 in every sum: the same result for any batch.
    cells = np.floor((np.round(unit * GRID) @ a + b) / (WIDTH * GRID * 65536)).astype(np.int64).reshape(len(unit), tables, k)
    key = np.zeros((len(unit), tables), np.uint64)
    for j in range(k):
        key = (key ^ cells[:, :, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keys(k: int, tables: int):
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = np.diff(t["v"].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, int)
            for d in np.unique(dims):
                part = t.filter(pa.array(dims == d))
                got = keys_of(_unit(matrix(part["v"])), k, tables)
                yield pa.record_batch({"rep": part["rep"].combine_chunks(), "keys": pa.array(list(got), pa.list_(pa.int64()))})

    return run


def spanning(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches through a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pairs(unit: np.ndarray, ids: np.ndarray, mult: np.ndarray, at: int, shape_: tuple[int, int], threshold: float, chunk: np.ndarray | None = None):
    """Rows with a link among these, sorted by id, of one table's bucket: (ids, link counts, smallest linked ids), or None.

    chunk: pairs within one chunk are another tile's business."""
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if chunk is not None:
        linked &= chunk[:, None] != chunk[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    count = np.zeros(len(some), np.int64)
    key = keys_of(unit[some], *shape_)
    for row, i in enumerate(some):
        with_ = np.flatnonzero(linked[i][some])
        first = (key[with_] == key[row]).argmax(axis=1) == at  # a pair counts in the first table that it shares
        count[row] = mult[some[with_[first]]].sum()
    return ids[some], count, ids[spanning(linked)[some]]


def _tile(k: int, tables: int, threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def task(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return schema.empty_table()
        ids, mult, chunk, tab, key, label = (t[c].to_numpy().astype(np.int64) for c in ("rep", "mult", "chunk", "tab", "key", "label"))
        ci, cj = (int(t[c][0].as_py()) for c in ("ci", "cj"))
        order = np.lexsort((ids, key, tab, label))
        ids, mult, chunk, tab = ids[order], mult[order], chunk[order], tab[order]
        unit = _unit(matrix(t["v"])[order])
        edge = np.flatnonzero(np.diff(key[order]) | np.diff(tab) | np.diff(label[order])) + 1
        found = [_pairs(unit[s:e], ids[s:e], mult[s:e], int(tab[s]), (k, tables), threshold, chunk[s:e] if ci != cj else None)
                 for s, e in zip(np.append(0, edge), np.append(edge, len(ids))) if e - s > 1]
        found = [x for x in found if x is not None]
        if not found:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    return task


def near_duplicates(spark: SparkSession, df: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "embed")
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull()
    v = e.cast("array<double>")
    mark = F.when(whole, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform(v, lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    rows = scratch.keep(df.select("vec_id", "label", F.when(mark.isNotNull(), v).alias("v"), mark.alias("mark")))
    # Equal vectors become one, with a number of its own.
    reps = rows.where("mark is not null").groupBy("mark").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = scratch.keep(reps.withColumn("nid", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    k, tables = shape(sizes, threshold)
    keyed = reps.select(F.col("nid").alias("rep"), "v").mapInArrow(_keys(k, tables), "rep long, keys array<long>")
    own = reps.select(F.col("nid").alias("rep"), "label", "mult")
    keyed = scratch.keep(keyed.join(own, "rep").select("rep", "label", "mult", F.posexplode("keys").alias("tab", "key")))
    full = scratch.keep(keyed.groupBy("label", "tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    part = keyed.join(full, ["label", "tab", "key"]).join(reps.select(F.col("nid").alias("rep"), "v"), "rep")
    part = part.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / TILE).cast("long")))
    part = tiles(part, "key", F.col("n"), F.col("rep"), TILE).withColumn("dim", F.size("v"))
    # Small buckets go to tasks many at once: a task finds their edges again by key.
    together = max(64, keyed.count() // BATCH)
    mark_ = F.xxhash64("label", "tab", "key")
    part = part.withColumn("large", F.col("n") > TILE).withColumn("grp", F.when(F.col("large"), mark_).otherwise(F.pmod(mark_, F.lit(together))))
    out = part.groupBy("large", "grp", "dim", "ci", "cj").applyInArrow(_tile(k, tables, threshold), "rep long, links long, root long")
    out = scratch.keep(out)
    links = scratch.keep(out.groupBy("rep").agg(F.sum("links").alias("links")))
    # Rows that share an id are one node, whatever their vectors.
    ids = rows.where("mark is not null and vec_id is not null").select("vec_id", "mark").distinct()
    ids = ids.join(reps.select("mark", "nid"), "mark")
    same = ids.groupBy("vec_id").agg(F.min("nid").alias("a"), F.max("nid").alias("b")).where("a < b")
    same = ids.join(scratch.keep(same.select("vec_id", "a")), "vec_id").select("a", F.col("nid").alias("b"))
    comp = components(scratch, out.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same))
    node = reps.select("mark", "nid", "rep", "mult").join(links.withColumnRenamed("rep", "nid"), "nid", "left").join(comp.withColumnRenamed("node", "nid"), "nid", "left")
    node = scratch.keep(node.select("mark", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "nid").alias("c")))
    least = scratch.keep(node.groupBy("c").agg(F.min("rep").alias("least")))
    info = scratch.keep(node.join(least, "c").select("mark", "n", F.col("least").alias("c")))
    got = rows.select("vec_id", "mark").join(info, "mark", "left")
    c = F.coalesce("c", "vec_id")
    return got.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), c).alias("component_id"), (F.col("vec_id").isNotNull() & (c == F.col("vec_id"))).alias("kept"))
