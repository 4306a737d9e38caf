"""Exact top-k search by block-at-a-time pruning.

Vectors become integers, floor(1024 * x). A component is a term; its impact may be negative, so a block of
vectors keeps the largest and the smallest impact of every term. For a query, the sum over terms of its weight
times the larger (weight > 0) or smaller (weight < 0) impact bounds every score in the block. Blocks are visited
in falling order of bound and scored through their forward index (the rows of the block) until the bound falls
below the k-th score so far. A bound equal to it is still visited, since a tie goes to the smaller id.

First a bounded set of ``SAMPLE`` rows, dealt out by hash, is scored for every query: the k-th score among them is no higher than the
true one, so every task begins with it as its threshold.

Distribution: rows are dealt to shards of bounded size, queries to blocks of bounded size, and each (shard, query
block) is one task that holds both; it returns k rows a query, and a window keeps the k best of all shards.
Inside a shard rows are first sorted by nearest pivot, so that blocks hold similar rows and bounds are tight.

Nulls and edges: vectors that are null, empty, or hold null or non-finite components take no part, neither do
null ids; vectors of different lengths are never compared; rows with the query's id are its own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 1024
EVERY = 100
K = 10
SHARD_ROWS = 8192
#: Queries of a block: all rows are sent once for each block, so blocks are as large as a task can hold.
QUERY_ROWS = 8192
#: Rows whose scores give the first thresholds.
SAMPLE = 2048
BLOCK_ROWS = 64
PIVOTS = 32


def vectors(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``keep`` columns and the embedding as doubles, of the rows whose vector is whole."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull()).select(
        "vec_id", *keep, e.cast("array<double>").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, (pa.ListArray, pa.LargeListArray)) else flat
    x = flat.to_numpy(zero_copy_only=False)
    return x.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores (-1 and the least integer where there are fewer) of the k best rows of x for every query,
    and the number of rows scored. All values are whole numbers; sums below 2**53 are exact as doubles. floor: for each query a score
    that k rows are known to reach; blocks bounded below it are left out."""
    exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53
    if not exact:
        q, x = q.astype(object), x.astype(object)
    pivots = x[:: max(1, len(x) // PIVOTS)][:PIVOTS]
    near = np.argmax((x @ pivots.T).astype(float), axis=1) if len(x) > BLOCK_ROWS else np.zeros(len(x), int)
    order = np.lexsort((x_id, near))
    x, x_id = x[order], x_id[order]
    n = -(-len(x) // BLOCK_ROWS)
    starts = np.arange(n) * BLOCK_ROWS
    high, low = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(x, starts, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bound.astype(float), axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    ids = np.full((len(q), k), -1, np.int64)
    top = np.full((len(q), k), none, np.int64)
    scored, live = 0, np.arange(len(q))
    floor = np.full(len(q), none, np.int64) if floor is None else floor
    for step in range(n):
        at = visit[live, step]
        go = bound[live, at].astype(float) >= np.maximum(top[live, -1], floor[live])
        live, at = live[go], at[go]
        if not len(live):
            break
        for b in np.unique(at):
            who = live[at == b]
            rows = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
            score = (q[who] @ x[rows].T).astype(np.int64)
            scored += score.size
            score[x_id[rows][None, :] == q_id[who][:, None]] = none
            s = np.concatenate([top[who], score], axis=1)
            i = np.concatenate([ids[who], np.broadcast_to(x_id[rows], score.shape)], axis=1)
            pick = np.lexsort((i, -s.astype(object) if not exact else -s.astype(float)), axis=-1)[:, :k]
            top[who], ids[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    return ids, top, scored


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, q = (np.floor(SCALE * matrix(t["v"])) for t in (left, right))
        x_id, q_id = (t["vec_id"].to_numpy().astype(np.int64) for t in (left, right))
        ids, top, _ = best(q, q_id, x, x_id, k, right["floor"].to_numpy().astype(np.int64))
        got = top > np.iinfo(np.int64).min
        return pa.table({"query_id": np.repeat(q_id, got.sum(1)), "vec_id": ids[got], "score": top[got]}, schema=schema)

    return task


def _floors(k: int, rows: dict[int, np.ndarray]):
    """Adds each query's k-th score among the sample's other rows of its length; the least integer where there are too few."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = np.diff(t["v"].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, int)
            floor = np.full(t.num_rows, np.iinfo(np.int64).min, np.int64)
            for d in np.unique(dims):
                x, at = rows.get(int(d)), np.flatnonzero(dims == d)
                if x is not None and len(x) > k:
                    q = np.floor(SCALE * matrix(t["v"].take(pa.array(at))))
                    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d < 2**53:
                        # The query's own row may be among them, so one score more is asked for.
                        floor[at] = np.partition(q @ x.T, len(x) - k - 1, axis=1)[:, len(x) - k - 1].astype(np.int64)
            yield pa.record_batch([*b.columns, pa.array(floor)], names=[*b.schema.names, "floor"])

    return run


def search(spark: SparkSession, df: DataFrame, *, every: int = EVERY, k: int = K) -> DataFrame:
    """The k best rows (query_id, rank, vec_id, score) for every row whose vec_id is divisible by ``every``."""
    v = vectors(df)
    queries = v.where(F.col("vec_id") % every == 0)
    n, nq = v.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-nq // QUERY_ROWS))
    # The sample: bounded, whatever it holds; rows of one id could be the query's own, so ids are distinct.
    picked = v.dropDuplicates(["vec_id"]) if n <= 4 * SAMPLE else v.where(F.pmod(F.xxhash64("vec_id"), F.lit(n // SAMPLE)) == 0).dropDuplicates(["vec_id"])
    picked = picked.limit(SAMPLE).select("v").toArrow()["v"]
    lengths = np.array([len(x) for x in picked], np.int64)
    sample = {int(d): np.floor(SCALE * matrix(picked.filter(pa.array(lengths == d)))) for d in np.unique(lengths)}
    queries = queries.mapInArrow(_floors(k, sample), "vec_id long, v array<double>, floor long")
    # A row's place in the files deals it out: also repeated ids spread evenly.
    d = v.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("dim", F.size("v"))
    q = queries.withColumn("block", (F.monotonically_increasing_id() % blocks).cast("int"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("dim", F.size("v"))
    keys = ("shard", "block", "dim")
    found = d.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
