"""Lanes, fusion, boosts and the final order. Every order is total: it ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.text import ascii_lower, normalize, occurrences

from .fulltext import find_all

#: Lanes in the order in which they first name themselves for a hit.
LANES = ("fts", "index", "body", "semantic")


def top(df: DataFrame, k: int | Column, *order: Column, by: str = "qid") -> DataFrame:
    """The k first rows of each query, with their position from 0."""
    ranked = df.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)
    return ranked.where(F.col("pos") < k)


def lane(df: DataFrame, name: str, k: int, *order: Column) -> DataFrame:
    """(qid, id, lane, pos, weight) of a lane's k best."""
    found = top(df, k, *order)
    return found.select("qid", "id", F.lit(name).alias("lane"), F.col("pos").cast("long").alias("pos"), F.lit(C.WEIGHTS[name]).alias("weight"))


def like(queries: DataFrame, chunks: DataFrame, name: str, columns: list[Column]) -> DataFrame:
    """Lane of the chunks in which a column holds the query (qid, needle), ASCII case aside; in order of id."""
    q = queries.where("needle <> ''").select("qid", ascii_lower(F.col("needle")).alias("needle"))
    got = find_all(chunks, q, *[ascii_lower(c) for c in columns]).join(q, "needle").select("qid", "id")
    return lane(got, name, C.LIKE_LIMIT, F.col("id"))


def fuse(lanes: DataFrame) -> DataFrame:
    """(qid, id, rrf, via): reciprocal ranks added up over lanes; via lists the lanes in their fixed order."""
    order = F.array(*[F.lit(x) for x in LANES])
    got = lanes.groupBy("qid", "id").agg(
        F.sum(F.col("weight") / (F.lit(C.RRF_K) + F.col("pos") + 1)).alias("rrf"), F.collect_set("lane").alias("seen"))
    return got.select("qid", "id", "rrf", F.filter(order, lambda x: F.array_contains(F.col("seen"), x)).alias("via"))


def boost(title: Column, body: Column, names: Column, q: Column) -> Column:
    """What a query in the title, a name or the body adds. All are normalised."""
    hits = occurrences(body, q)
    in_body = F.lit(4.0) * hits / (F.lit(1.0) + F.greatest(F.length(body), F.lit(1)) / F.lit(160.0))
    return (
        F.when(q == "", F.lit(0.0)).when(title == q, F.lit(12.0)).when(F.contains(title, q), F.lit(8.0))
        .when(F.exists(names, lambda a: F.contains(a, q)), F.lit(6.0)).when(hits > 0, in_body).otherwise(F.lit(0.0)))


def index_like(title: Column, names: Column, via: Column, q: Column) -> Column:
    """Whether a hit is about the query by name."""
    return (q != "") & (F.array_contains(via, "index") | F.contains(title, q) | F.exists(names, lambda a: F.contains(a, q)))


def dedup_titles(hits: DataFrame) -> DataFrame:
    """The best hit of each (qid, doc_id, normalised title)."""
    w = W.partitionBy("qid", "doc_id", "ntitle").orderBy(F.desc("rrf"), "id")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def finish(fused: DataFrame, chunks: DataFrame, queries: DataFrame, table=("", "")) -> DataFrame:
    """Fused hits to the final (qid, rank, id, score, via). queries: qid and the normalised query q."""
    best = top(fused, C.FUSED, F.desc(F.round("rrf", 12)), F.col("id")).drop("pos")
    slim = chunks.select("id", "doc_id", "title", "body", "names", "source_rank")
    hits = slim.join(best, "id").join(queries.select("qid", "q"), "qid")
    hits = hits.withColumn("ntitle", normalize(F.col("title"), table))
    names = F.transform("names", lambda a: normalize(a, table))
    hits = dedup_titles(hits)
    hits = hits.withColumn("score", F.col("rrf") + boost(F.col("ntitle"), normalize(F.col("body"), table), names, F.col("q")))
    hits = hits.withColumn("named", index_like(F.col("ntitle"), names, F.col("via"), F.col("q")))
    order = (F.desc("named"), F.desc(F.round("score", 12)), F.col("source_rank"), F.col("title"), F.col("id"))
    out = top(hits, C.RETURNED, *order)
    return out.select("qid", (F.col("pos") + 1).alias("rank"), "id", "score", "via")


def recall(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Share of the judged queries with a relevant chunk (qid, id) among their k first hits (qid, rank, id)."""
    good = hits.where(F.col("rank") <= k).join(relevant, ["qid", "id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1))
    return relevant.select("qid").distinct().join(good, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
