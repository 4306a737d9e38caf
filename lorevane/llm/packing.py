"""Best-fit packing of token sequences, in bulk-synchronous rounds.

A document's ids end with id 0. Documents over ``capacity`` are cut into full pieces, the remainder first; every
piece is an item of 1 to ``capacity`` tokens.

Items of equal length are interchangeable, and so are gaps of equal length. Items and gaps are therefore kept
range-sorted as runs: (length, how many). A round takes the longest items left and sweeps the gaps upward from
their length: the successor gap takes as many items as it has sequences, by rank, the gaps that result are put
back in order, and so on until the round's items are placed; new sequences open only when no gap fits. This is
best-fit decreasing, done for all items of a length at once: of items that want the same gap, those of lower rank have it, and the others
sweep on. The state is at most ``capacity`` runs of items and of gaps and does not grow with the documents, so one task over the
counts does all rounds. What is distributed is the rest: tokenising, counting, ranking the items of each length and looking the
ranks up in the rounds' result. The driver holds no placement. Each piece carries its ids; ``sequences`` puts them together.

Ranks: the task that tokenises a text numbers its pieces of each length as it goes; running counts of the tasks before shift the
numbers. So items are ranked without being sorted or moved, whatever length a third of them has.

Nulls and edges: a null text is empty, and an empty one has the single id 0; null and repeated ids are separate
documents; the text of a special token is matched as ``tokenizers`` does; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Ids that are handed on at once, about.
CHUNK = 1_000_000


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@functools.lru_cache(1)
def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS):
    """text -> ids as ``tokenizers`` gives them. The rank file holds the same vocabulary; its encoder gives the
    same ids in a quarter of the time and is used for texts without a special token."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(_path(tokenizer))
    slow = lambda text: full.encode(text, add_special_tokens=False).ids
    if not ranks:
        return slow
    import public_tokenizers
    import tiktoken

    with open(_path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if SPECIAL in text else fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(capacity: int, tokenizer: str, ranks: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("part", pa.int32()), ("i", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def out(rows, ids):
        ends = np.cumsum([0, *(r[3] for r in rows)]).astype(np.int32)
        return pa.record_batch([*(pa.array(c, t) for c, t in zip(zip(*rows), schema.types)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32)))], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer, ranks), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows, all_ids, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                for i, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, i, s, n, part, seen[n]))
                    seen[n] += 1
                    all_ids.append(ids[s : s + n])
                    held += n
                    if held > CHUNK:
                        yield out(rows, all_ids)
                        rows, all_ids, held = [], [], 0
            if rows:
                yield out(rows, all_ids)

    return run


def digest(packed: DataFrame) -> DataFrame:
    """``packed`` with the crc32 of the ids that each row carries, ids_crc32 (little-endian, 4 bytes each), in place of the ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        for b in batches:
            ids = b.column(6)
            values, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum([0, *ids.value_lengths().to_pylist()])
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(at, at[1:])]
            yield pa.record_batch([*b.columns[:4], pa.array(crc, pa.int64()), *b.columns[4:6]], names=names)

    return packed.select(*(n for n in names if n != "ids_crc32"), "ids").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences, ``capacity`` ids each at most: sequence_id, ids."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda x: x["ids"])).alias("ids"))


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the items of each rank go."""
    gaps: list[int] = []  # in order
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap not in runs:
            bisect.insort(gaps, gap)
        runs.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            i = bisect.bisect_left(gaps, size)
            if i == len(gaps):
                n = -(-left // (capacity // size))
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[i]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[i]
            take = min(n, left)
            out.append((size, rank, rank + take, first, capacity - gap))
            if take < n:
                put(gap, first + take, n - take)
            if gap > size:
                put(gap - size, first, take)
            rank, left = rank + take, left - take
    return out


def _placements(capacity: int):
    schema = pa.schema([(x, pa.int64()) for x in ("size", "lo", "hi", "first", "offset")])

    def task(t: pa.Table) -> pa.Table:
        rows = rounds(dict(zip(t["length"].to_pylist(), t["n"].to_pylist())), capacity)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else schema.empty_table()

    return task


def pack(
    spark: SparkSession, docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, sequence_id, offset, ids (its token ids)."""
    scratch = Scratch(spark, "pack")
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(capacity, tokenizer, ranks), "doc_id long, piece int, start long, length long, part int, i long, ids array<int>")
    pieces = scratch.keep(pieces)
    have = scratch.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = have.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = have.groupBy("length").agg(F.sum("n").alias("n"))  # capacity rows at most
    placed = scratch.keep(counts.groupBy(F.lit(0).alias("all")).applyInArrow(_placements(capacity), "size long, lo long, hi long, first long, offset long"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("i"))
    # The rounds' result depends on the lengths that occur, never on how many items have them.
    at = (F.col("size") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(placed), at).select(
        "doc_id", "piece", "start", "length", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "ids")
