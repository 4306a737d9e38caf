"""What several operators share: reading tables, words, bounded tiles and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .words import mix

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def tiles(df: DataFrame, group: str, size: Column, item: Column, most: int) -> DataFrame:
    """Adds ``ci`` and ``cj``: each row goes to every pair of chunks that its own chunk is in.

    A group of ``size`` rows has ceil(size / most) chunks, so each (group, ci, cj) holds about 2 * most
    rows at most and every two rows of a group meet in some tile.
    """
    df = df.withColumn("_n", F.ceil(F.greatest(size, F.lit(1)) / F.lit(most)).cast("int"))
    df = df.withColumn("_c", F.pmod(F.xxhash64(item), F.col("_n").cast("long")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return (
        df.withColumn("ci", F.least("_c", "_o")).withColumn("cj", F.greatest("_c", "_o")).drop("_n", "_c", "_o")
    )


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each node of ``edges`` (a, b: long): rows (node, component).

    Contraction rounds: each node moves to the smallest of its neighbourhood in a random order of the
    nodes (a bijective hash of the id), edges follow, loops go. A round leaves a fraction of the nodes, even
    on chains and stars. Every step is a join or a minimum with map-side combination; nothing is collected.
    """
    keep = scratch.keep
    edges = edges.where("a is not null and b is not null and a <> b")
    ids = keep(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.xxhash64("id").alias("h")))
    e = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    e = keep(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    moves: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        mu = m.select(F.col("u"), F.col("m").alias("mu"))
        mv = m.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        nxt = e.join(mu, "u").join(mv, "v").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
        nxt = keep(nxt.where("u <> v").distinct())
        scratch.drop(e)
        moves.append(m)
        e = nxt
    if not moves:
        return ids.select(F.col("id").alias("node"), F.col("id").alias("component"))
    label = moves[-1]
    for m in reversed(moves[:-1]):
        up = label.select(F.col("u").alias("m"), F.col("m").alias("top"))
        label = m.join(up, "m", "left").select("u", F.coalesce("top", "m").alias("m"))
    found = keep(ids.join(label, ids["h"] == label["u"]).select("id", F.col("m").alias("rep")))
    least = keep(found.groupBy("rep").agg(F.min("id").alias("component")))
    return keep(found.join(least, "rep").select(F.col("id").alias("node"), "component"))


def running(scratch: Scratch, rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds ``at``, each row's number from 0 in this order, and for each column of ``sums`` the sum of the rows before it, under
    its new name. Ranges of the order are summed on their own and shifted by the sums of the ranges before."""
    d = scratch.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = parts.select("_part", zero("_n", ahead).alias("_at"), *[zero(f"_{c}", ahead).alias(f"_{new}") for c, new in sums.items()])
    inside = W.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.row_number().over(inside) - 1)
    for c, new in sums.items():
        d = d.withColumn(new, zero(c, before))
    d = d.join(parts, "_part")
    return d.select(*rows.columns, (F.col("at") + F.col("_at")).alias("at"), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums.values()])


#: Bits of a sieve: 8 MB at any size.
SIEVE_BITS = 26


def _places(h: np.ndarray) -> np.ndarray:
    """Three bits for each 64-bit key."""
    h = h.astype(np.int64).view(np.uint64)
    return np.stack([mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SIEVE_BITS) for i in (1, 2, 3)])


def sieve(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys (h: long), as words of 64 bits. It lets all of them pass, and few others as long as there are not too
    many for its size, which is fixed; with more of them it just saves less."""

    def run(batches):
        words = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
        for b in batches:
            at = _places(b.column(0).to_numpy()).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.record_batch({"w": pa.array(part, pa.int64()), "bits": pa.array(words[part].view(np.int64))})

    got = keys.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()  # a sieve's words at most
    out = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def sifted(spark: SparkSession, rows: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows (h: long, first column) that pass a sieve."""
    held = spark.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy())
            hit = (held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)
            if hit.any():
                yield b.filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)
