"""Vector retrieval: exact inner products, the best part of each chunk, and upkeep of the vectors.

Queries are a stated set against all vectors. Both are dealt into parts of bounded size, and a pair of parts is one matrix
product, of which a task hands on only the best chunks per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.lift import SPACES, lift

from .ranking import lane

#: Vectors and queries of one task.
SHARD_ROWS = 16384
QUERY_ROWS = 1024
#: Scores that a task holds at once: 8 MB of them, whatever the sizes of its parts.
SCORES = 1 << 20
#: Digits that count for the order: copies of a vector get equal scores, wherever they stand in a product.
DIGITS = 9


def _first(score: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the k highest, best first; of equals the first places."""
    if k is None or len(score) <= k:
        return np.argsort(-score, kind="stable")
    own = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return own[np.argsort(-score[own], kind="stable")[:k]]


def _best_of(k: int | None):
    schema = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        v, q = (np.asarray(t["v"].combine_chunks().flatten()).astype(np.float64).reshape(t.num_rows, -1) for t in (left, right))
        # Parts of a chunk side by side: the best of each is one reduction.
        chunk, ids = left["chunk_id"].to_numpy(), right["qid"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        chunk, start = np.unique(chunk[order], return_index=True)
        v = v[order]
        qids, chunks, scores = [], [], []
        step = max(1, SCORES // len(v))
        for at in range(0, len(q), step):
            score = np.maximum.reduceat(q[at : at + step] @ v.T, start, axis=1)
            for i, row, rough in zip(ids[at : at + step], score, np.round(score, DIGITS)):
                best = _first(rough, k)
                qids.append(np.full(len(best), i))
                chunks.append(chunk[best])
                scores.append(row[best])
        return pa.table({"qid": np.concatenate(qids), "chunk_id": np.concatenate(chunks), "score": np.concatenate(scores)}, schema=schema)

    return task


def best_parts(queries: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, chunk_id, score): the best part of chunks (chunk_id, v) for each query (qid, qv); with k, of the chunks that are
    among the k best of their shard.

    Vectors are dealt to shards and queries to blocks, both of bounded size; each pair of them is one task with one matrix
    product."""
    keep = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    v = vectors.where(keep("v")).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("v").cast("array<double>").alias("v"))
    q = queries.where(keep("qv")).select(F.col("qid").cast("long").alias("qid"), F.col("qv").cast("array<double>").alias("v"))
    shards, blocks = (max(1, -(-d.count() // n)) for d, n in ((v, SHARD_ROWS), (q, QUERY_ROWS)))
    both = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    left = v.withColumn("shard", place(shards)).withColumn("block", both(blocks)).withColumn("dim", F.size("v"))
    right = q.withColumn("block", place(blocks)).withColumn("shard", both(shards)).withColumn("dim", F.size("v"))
    keys = ("shard", "block", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of(k), "qid long, chunk_id long, score double")
    return found.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))


def top_chunks(queries: DataFrame, vectors: DataFrame, k: int = C.VECTOR_LIMIT) -> DataFrame:
    """(qid, chunk_id, score): the k best chunks of each query, by their best part; scores are rounded to ``DIGITS``, and ties go by id. A shard
    hands on k chunks a query; the k best of all chunks are among those."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return best_parts(queries, vectors, k).withColumn("score", F.round("score", DIGITS)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def semantic_lane(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    got = top_chunks(queries, vectors).withColumnRenamed("chunk_id", "id")
    return lane(got, "semantic", C.VECTOR_LIMIT, F.desc("score"), F.col("id"))


SENTENCE_ENDS = "。！？；\n"


def windows_of(body: str) -> list[str]:
    """A body in windows of up to 400 characters that end at a sentence or line where one ends in the second half, and
    repeat the last 50 of the one before."""
    out, start = [], 0
    while True:
        end = min(start + C.WINDOW, len(body))
        if end < len(body):
            last = max(body.rfind(c, start + C.WINDOW // 2, end) for c in SENTENCE_ENDS)
            end = last + 1 if last >= 0 else end
        out.append(body[start:end].strip(SPACES))
        if end >= len(body):
            return [x for x in out if x]
        start = max(end - C.WINDOW_OVERLAP, start + 1)


def windows(body: Column) -> Column:
    return lift(windows_of, "array<string>")(body)


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def all_or_none(encoded: DataFrame) -> DataFrame:
    """Parts (chunk_id, seq, v) of the chunks of which every part was encoded."""
    w = W.partitionBy("chunk_id")
    return encoded.withColumn("_ok", F.every(F.col("v").isNotNull()).over(w)).where("_ok").drop("_ok")


def same_model(meta: DataFrame, now: dict[str, str]) -> bool:
    """Whether the stored vectors come from this model: id, fingerprint, pooling and query prefix."""
    row = meta.first()
    return row is not None and all(row[k] == now[k] for k in ("model_id", "model_version", "pooling", "query_prefix"))
