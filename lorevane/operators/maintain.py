"""Incremental upkeep of tables: change and rename detection, upserts, corrections, retention, neighbours, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.scratch import Scratch


def detect(files: DataFrame, known: DataFrame, *, reprocess: bool = False) -> DataFrame:
    """Files (rel_path, content_hash, ...) with what to do: status 'skip', 'changed', 'moved' or 'new', and doc_id if it is known.

    A file at an unknown path whose content exactly one known document has is that document, moved. Of several such files
    the first by path moves it and the last one's path stays, as if they had come one after another."""
    k = known.select(F.col("file_path").alias("_p"), F.col("content_hash").alias("_h"), F.col("doc_id").alias("_id"))
    at = files.join(k, F.col("rel_path") == F.col("_p"), "left")
    alone = k.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_m")).where("_n = 1").select(F.col("_h").alias("_g"), "_m")
    out = at.join(alone, (F.col("content_hash") == F.col("_g")) & F.col("_id").isNull(), "left")
    same = F.lit(not reprocess) & (F.col("content_hash") == F.col("_h"))
    status = F.when(F.col("_id").isNotNull(), F.when(same, F.lit("skip")).otherwise(F.lit("changed"))).when(F.col("_m").isNotNull(), F.lit("moved")).otherwise(F.lit("new"))
    return out.select(*files.columns, status.alias("status"), F.coalesce("_id", "_m").alias("doc_id"))


def moves(detected: DataFrame) -> DataFrame:
    """The path that each moved document ends with: (doc_id, rel_path)."""
    return detected.where("status = 'moved'").groupBy("doc_id").agg(F.max("rel_path").alias("rel_path"))


def collapse(detected: DataFrame) -> DataFrame:
    """New files of equal content as one document, under the last of their paths."""
    w = W.partitionBy("content_hash").orderBy(F.desc("rel_path"))
    new = detected.where("status = 'new'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return detected.where("status <> 'new'").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert in which a null of the new row keeps the old row's value."""
    rest = [c for c in old.columns if c not in keys]
    both = old.join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns]), keys, "full_outer")
    return both.select(*[F.col(c) if c in keys else (F.coalesce(f"_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of changed parents go, their new rows come."""
    return old.join(changed.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def last_write(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The latest row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def number(rows: DataFrame, start: int, order: list[str], scratch: Scratch, into: str = "id") -> DataFrame:
    """Ids from ``start`` on, in order, without sorting all rows in one task: ranges of the order are numbered on their own
    and shifted by the sizes of the ranges before."""
    ordered = scratch.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = W.partitionBy("_part").orderBy(*order)
    out = ordered.withColumn("_i", F.row_number().over(w)).join(base, "_part")
    return out.withColumn(into, F.col("_base") + F.col("_i") + F.lit(start - 1)).drop("_part", "_i", "_base")


def retain(log: DataFrame, by: str, keep: int, *latest: Column) -> DataFrame:
    """The ``keep`` latest rows of each group."""
    w = W.partitionBy(by).orderBy(*latest)
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def neighbours(chunks: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Each chunk with the ids before and after it."""
    w = W.partitionBy(by).orderBy(order)
    return chunks.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def _paired(drafts: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """k-th draft with the k-th correction of the same document and key: (draft, correction)."""
    d = drafts.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", key).orderBy("ordinal")))
    c = corrections.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", key).orderBy("correction_id")))
    return d.join(c.select("doc_id", key, "_k", "correction_id"), ["doc_id", key, "_k"]).select("doc_id", "ordinal", "correction_id")


def match_corrections(drafts: DataFrame, corrections: DataFrame) -> DataFrame:
    """(doc_id, ordinal, correction_id): each correction goes to one draft, by stable key, then by anchor among what is left."""
    one = _paired(drafts, corrections, "stable_key")
    rest = drafts.join(one.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")
    left = corrections.join(one.select("correction_id"), "correction_id", "left_anti").where("alt_anchor is not null")
    return one.unionByName(_paired(rest, left, "alt_anchor"))


def apply_corrections(drafts: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts with their corrections, and the corrections that no draft took. Set fields win; names are added."""
    pairs = match_corrections(drafts, corrections)
    c = corrections.select("correction_id", F.col("entity_type").alias("_e"), F.col("visibility").alias("_v"), F.col("names").alias("_a"))
    d = drafts.join(pairs, ["doc_id", "ordinal"], "left").join(c, "correction_id", "left")
    d = d.withColumn("entity_type", F.coalesce("_e", "entity_type")).withColumn("visibility", F.coalesce("_v", "visibility"))
    d = d.withColumn("names", F.when(F.col("_a").isNull(), F.col("names")).otherwise(F.array_union("names", "_a")))
    return d.select(*drafts.columns), corrections.join(pairs.select("correction_id"), "correction_id", "left_anti")


def patch(chunks: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live chunks after patches (id, entity_type, visibility, names; null keeps), and the corrections to store: all
    three fields of each patched chunk, so that one set field pins the others too."""
    p = patches.select("id", F.col("entity_type").alias("_e"), F.col("visibility").alias("_v"), F.col("names").alias("_a"), F.lit(True).alias("_p"))
    d = chunks.join(p, "id", "left")
    for col, new in (("entity_type", "_e"), ("visibility", "_v"), ("names", "_a")):
        d = d.withColumn(col, F.coalesce(new, col))
    stored = d.where("_p").select("doc_id", "stable_key", "alt_anchor", "entity_type", "visibility", "names")
    return d.select(*chunks.columns), stored


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, term) with what each term stands for, one step only, distinct."""
    more = terms.join(synonyms.select("term", "canonical"), "term").select("qid", F.col("canonical").alias("term"))
    return terms.select("qid", "term").unionByName(more).distinct()


def coalesce_runs(rows: DataFrame, by: str, order: list[str], value: str, text: str) -> DataFrame:
    """Runs of equal values in order, as one row each: (by, run, value, n, text)."""
    w = W.partitionBy(by).orderBy(*order)
    begins = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    d = rows.withColumn("_b", begins).withColumn("run", F.sum("_b").over(w))
    grouped = d.groupBy(by, "run").agg(
        F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*order, text))).alias("_t"))
    return grouped.select(by, "run", value, "n", F.array_join(F.transform("_t", lambda x: x[text].cast("string")), "\n").alias(text))


def import_report(status: DataFrame) -> DataFrame:
    """One row of counters over files (class, status, error, message, path, chunks, unmatched, warning)."""
    skipped = F.col("class").isin("skip", "unsupported") | (F.col("status") == "skip")
    failed = F.col("error").isNotNull()
    return status.agg(
        F.count_if((F.col("class") == "doc") & ~F.coalesce(skipped, F.lit(False)) & ~failed).alias("files_ok"), F.count_if(skipped & ~failed).alias("files_skip"), F.count_if(failed).alias("files_fail"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched_corrections"),
        F.array_sort(F.collect_list(F.coalesce("error", F.when(F.col("message").isNotNull(), F.concat_ws(": ", "path", "message"))))).alias("errors"),
        F.array_sort(F.collect_list("warning")).alias("warnings"))


def info(chunks: DataFrame, meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: number of chunks, and whether vectors and their description are there."""
    some = lambda d, name: d.limit(1).agg(F.count(F.lit(1)).alias(name))
    n = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first_doc"))
    d = n.crossJoin(F.broadcast(some(meta, "m"))).crossJoin(F.broadcast(some(vectors, "v")))
    return d.select("chunks", "first_doc", ((F.col("m") > 0) & (F.col("v") > 0)).alias("semantic_ready"), F.lit(C.SCHEMA_VERSION).alias("schema_version"))
