"""Similarity of short texts by character bigrams, and fuzzy matching of a text against segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.text import SPACE, let


def bigrams(c: Column) -> Column:
    def cut(chars: Column) -> Column:
        at = F.when(F.size(chars) >= 2, F.sequence(F.lit(1), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i)))

    return let(F.split(F.regexp_replace(c, f"[{SPACE}]", ""), ""), cut)


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams over all bigrams; 0 if a text has none."""
    def of(g: Column) -> Column:
        ga, gb = g["a"], g["b"]
        none = (F.size(ga) == 0) | (F.size(gb) == 0)
        return F.when(none, F.lit(0.0)).otherwise(F.lit(2.0) * shared(ga, gb) / (F.size(ga) + F.size(gb)))

    return let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), of)


def _prefix(counts: DataFrame, sizes: DataFrame, df: DataFrame, by: list[str], least: float) -> DataFrame:
    """The rarest bigrams of each text: as many as must hold one of those that it shares with a text this much alike."""
    # Equal bigrams of a text are told apart by number, so that its bigrams are a set.
    tokens = counts.select(*by, "_g", F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_k"))
    rarest = W.partitionBy(*by).orderBy("_df", "_g", "_k")
    shared_keys = [c for c in df.columns if c != "_df"]
    ranked = tokens.join(df, shared_keys).withColumn("_at", F.row_number().over(rarest)).join(sizes, by)
    return ranked.where(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * F.lit(least / (2 - least)) - F.lit(1e-9)) + 1)


def _counts(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    return texts.select(*by, F.explode(bigrams(F.col(text))).alias("_g")).groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("_c"))


def best_segment(needles: DataFrame, segments: DataFrame, key: str, *, apart: bool = False) -> DataFrame:
    """For each needle (key, nid, needle, from) the segment (key, idx, offset, text) of its block that is most alike, if it is
    alike enough and ends after ``from``; the first of equals. With ``apart`` the segment of which idx is nid is not its own.

    Equal texts of a block are compared once, and only texts that share one of their rarest bigrams, without which they can't be
    alike enough. Of segments with equal texts and ends the first will do, or with ``apart`` the first two."""
    bare = lambda c: F.regexp_replace(c, f"[{SPACE}]", "")
    n = needles.where(F.length("needle") >= 4).withColumn("_a", bare(F.col("needle")))
    s = segments.select(key, "idx", "offset", "text", (F.col("offset") + F.length("text")).alias("_end"), bare(F.col("text")).alias("_b"))
    first = W.partitionBy(key, "_b", "_end").orderBy("idx")
    s = s.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= (2 if apart else 1)).drop("_r")
    # A block's texts, with their sides: the order of bigrams has to be one for both.
    sides = n.select(key, F.col("_a").alias("_t"), F.lit(True).alias("_own")).unionByName(s.select(key, F.col("_b").alias("_t"), F.lit(False).alias("_own")))
    texts = sides.where(F.length("_t") >= 2).groupBy(key, "_t").agg(F.bool_or("_own").alias("_needle"), F.bool_or(~F.col("_own")).alias("_segment"))
    by = [key, "_t"]
    counts = _counts(texts, by, "_t")
    df = counts.select(key, "_g", F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_k")).groupBy(key, "_g", "_k").agg(F.count(F.lit(1)).alias("_df"))
    prefix = _prefix(counts, counts.groupBy(*by).agg(F.sum("_c").alias("_n")), df, by, C.DICE).join(texts, by)
    one, two = (prefix.where(side).select(key, F.col("_t").alias(x), F.col("_n").alias(f"_n{x}"), "_g", "_k") for side, x in (("_needle", "_a"), ("_segment", "_b")))
    # What the shorter text has at most has to be enough.
    enough = F.lit(2.0) * F.least("_n_a", "_n_b") / (F.col("_n_a") + F.col("_n_b")) >= C.DICE
    pairs = one.join(two, [key, "_g", "_k"]).where(enough).select(key, "_a", "_b").distinct()
    pairs = pairs.withColumn("sim", dice(F.col("_a"), F.col("_b"))).where(F.col("sim") >= C.DICE)
    d = n.join(pairs.join(s, [key, "_b"]), [key, "_a"]).where(F.col("_end") > F.col("from"))
    d = d.where("nid <> idx") if apart else d
    best = F.min(F.struct((-F.col("sim")).alias("far"), "idx", "offset", "text", "needle", "from", "sim"))
    return d.groupBy(key, "nid").agg(best.alias("x")).select(key, "nid", *[F.col(f"x.{c}").alias(c) for c in ("needle", "from", "idx", "offset", "text", "sim")])


def alike_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of the texts (id, text) whose likeness is ``least`` or more, a < b.

    Two such texts share more bigrams than the longer part of either's, so one of the rarest few of each is among them: only
    these few are joined, and no common bigram brings all its texts together."""
    counts = _counts(texts, ["id"], "text")
    sizes = counts.groupBy("id").agg(F.sum("_c").alias("_n"))
    df = counts.select("_g", F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_k")).groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_df"))
    prefix = _prefix(counts, sizes, df, ["id"], least)
    one, two = (prefix.select(F.col("id").alias(x), "_g", "_k") for x in "ab")
    pairs = one.join(two, ["_g", "_k"]).where("a < b").select("a", "b").distinct()
    ca, cb = (counts.select(F.col("id").alias(x), "_g", F.col("_c").alias(f"c{x}")) for x in "ab")
    both = pairs.join(ca, "a").join(cb, ["b", "_g"]).groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("s"))
    na, nb = (sizes.select(F.col("id").alias(x), F.col("_n").alias(f"n{x}")) for x in "ab")
    sim = F.lit(2.0) * F.col("s") / (F.col("na") + F.col("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", sim.alias("sim")).where(F.col("sim") >= least)
