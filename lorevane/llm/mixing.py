"""Mixing sources to target weights by capped water-filling.

Targets: each source gets budget in proportion to its weight, but at most ``max_epochs`` times its size;
what is clamped off flows to the others by weight until none is above. The fixed point min(cap, level * weight)
is found at once: sources in order of cap / weight, running sums of both, and the first prefix of clamped
sources whose level leaves the next one below its cap.

Sampling: a source that needs e epochs repeats every document floor(e) times, and one more time the documents
that come first in a seeded order until the rest of the target is reached. Order and running sums stay
distributed: a hash prefix deals a source's documents to buckets, bucket sums tell which single bucket the
target ends in, and only that bucket is sorted, so a source with a third of all rows is no single task.

Nulls and edges: a null text has size 0; null sources form one source, last; a null doc_id is a document like
others; repeated rows are sampled separately; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import n_words, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Hex digits of the order that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Sources may be many, say web hosts: orders and running sums over
    them go range by range, and only one row a range meets in one task."""
    s = running(scratch, sizes, [F.col("source").asc_nulls_last()], {})
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    s = s.select("source", "source_size", F.col("at").alias("i"), pick.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    s = running(scratch, s, [(F.col("cap") / F.col("w")).asc(), F.col("i").asc()], {"cap": "before", "w": "light"})
    all_ = s.agg(F.sum("source_size"), F.sum("w")).first()
    total, weight = all_[0] or 0, all_[1] or 0.0
    level = (F.lit(float(total) * float(share)) - F.col("before")) / (F.lit(float(weight)) - F.col("light"))
    s = s.withColumn("level", level)
    # The first source in this order that stays below its cap gives the level of all after it.
    top = s.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct((F.col("cap") / F.col("w")).alias("r"), "i", "level"))["level"]).first()[0]
    goal = F.col("cap") if top is None else F.least(F.col("cap"), F.lit(float(top)) * F.col("w"))
    return s.select("source", "source_size", goal.alias("target"))


def unnamed() -> Column:
    """What orders a document without an id: its text, so that many of them are not at one place of the order."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("unnamed")


def mix(
    docs: DataFrame, scratch: Scratch, *, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
    seed: int = 1, cut_last: bool = True,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and copies, the whole repetitions.

    ``cut_last``: the one document of a source at which the target is reached gives just the words that are
    missing; without it, that document is repeated whole if more than half of it is missing, else not.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), unnamed())
    return plan(slim, scratch, weights=weights, share=share, max_epochs=max_epochs, seed=seed, cut_last=cut_last)


def plan(
    slim: DataFrame, scratch: Scratch, *, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
    seed: int = 1, cut_last: bool = True, extra: tuple[str, ...] = (),
) -> DataFrame:
    """``mix`` for rows (doc_id, source, size, unnamed) whose sizes are known; ``extra`` columns come through."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.col("unnamed")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary"))
    slim = slim.withColumn("ord", order).drop("unnamed")
    slim = scratch.keep(slim.withColumn("b", F.substring("ord", 1, BUCKET_DIGITS)))
    # Sums of each bucket, then running sums over the buckets of a source: 4096 rows a source at most.
    bucket = scratch.keep(slim.groupBy("source", "b").agg(F.sum("size").alias("words")))
    goal = targets(bucket.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, share, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = scratch.keep(goal)
    run = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    bucket = bucket.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)).cast("long"))
    same = bucket["source"].eqNullSafe(goal["source"])
    bucket = scratch.keep(bucket.join(goal, same).select(
        bucket["source"], "b", "source_size", "target", "whole", "need", "before",
        ((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))).alias("ends")))
    keys = slim["source"].eqNullSafe(bucket["source"]) & (slim["b"] == bucket["b"])
    rows = slim.join(bucket, keys).select("doc_id", *extra, slim["source"], "size", "source_size", "target", "whole", "need", "before", "ends", "ord")
    far = rows.where("not ends").withColumn("more", F.when(F.col("before") < F.col("need"), F.col("size")).otherwise(F.lit(0)))
    inside = W.partitionBy("source").orderBy("ord", "doc_id", "size", *extra).rowsBetween(W.unboundedPreceding, -1)
    near = rows.where("ends").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    left = F.least(F.col("size"), F.greatest(F.col("need") - F.col("at"), F.lit(0)))
    if not cut_last:
        left = F.when(left * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0))
    near = near.withColumn("more", left).drop("at")
    out = far.unionByName(near).withColumn("more", F.col("more").cast("long"))
    return out.select(
        "doc_id", *extra, "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("more")).alias("taken"),
        (F.col("whole") + ((F.col("more") == F.col("size")) & (F.col("size") > 0)).cast("long")).alias("copies"),
    )


def repeat(docs: DataFrame, scratch: Scratch, *, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts stay whole."""
    mark = F.xxhash64("text", "lang") if "lang" in docs.columns else F.xxhash64("text")
    slim = docs.select("doc_id", mark.alias("mark"), "source", n_words(F.col("text")).alias("size"), unnamed())
    found = plan(slim, scratch, weights=weights, share=share, max_epochs=max_epochs, seed=seed, cut_last=False, extra=("mark",))
    # Rows alike in all of these count as one here, with the copies of all of them dealt out evenly.
    times = scratch.keep(found.groupBy("doc_id", "mark", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    # The columns of docs travel as one, so that none of their names can clash.
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("a"), mark.alias("b"), F.col("source").alias("c"))
    same = d["a"].eqNullSafe(times["doc_id"]) & (d["b"] == times["mark"]) & d["c"].eqNullSafe(times["source"])
    n = F.ceil(F.col("copies") / F.col("rows")).cast("int")
    out = d.join(times.where("copies > 0"), same).select("row", F.explode(F.sequence(F.lit(1), n)))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
