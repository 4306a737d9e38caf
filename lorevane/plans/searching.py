"""The read path: a batch of queries to ranked hits, as one plan.

A query's terms go to lanes; lanes that only run when earlier ones found little are gated by a count per query, so
queries of one batch may take different roads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions.terms import extract_udf
from lorevane.functions.text import has_hanzi, has_long_run, hanzi_count, normalize
from lorevane.operators import fulltext, ranking, vector
from lorevane.operators.maintain import expand_synonyms
from lorevane.scratch import Scratch


def terms(queries: DataFrame, readings: dict, synonyms: DataFrame | None = None, *, relaxed: bool = False) -> DataFrame:
    """(qid, term) of normalised queries (qid, q), with what synonyms add; distinct."""
    extract = extract_udf(readings, C.RELAXED_GRAM_CAP if relaxed else C.GRAM_CAP)
    found = queries.select("qid", F.explode(extract("q")).alias("term"))
    return expand_synonyms(found, synonyms) if synonyms is not None and not relaxed else found.distinct()


def prepare(queries: DataFrame, table=("", "")) -> DataFrame:
    """Queries (qid, text) with their capped, normalised form q."""
    return queries.select("qid", normalize(F.substring("text", 1, C.QUERY_CHARS), table).alias("q"))


def gate(queries: DataFrame, lanes: DataFrame, few: int = C.FEW) -> DataFrame:
    """The queries for which the lanes found fewer than ``few`` chunks."""
    many = lanes.groupBy("qid").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= few)
    return queries.join(many, "qid", "left_anti")


def search(
    queries: DataFrame, chunks: DataFrame, *, readings: dict | None = None, table=("", ""), synonyms: DataFrame | None = None,
    postings: DataFrame | None = None, stats: DataFrame | None = None, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None,
    only: Column | None = None, each_term: bool = False,
) -> DataFrame:
    """(qid, rank, id, score, via) for queries (qid, text).

    chunks: id, doc_id, title, body, names, parent_path, source_rank, search_text. With query_vectors (qid, qv) and vectors
    (chunk_id, v) the semantic lane runs too; leave them out when the vectors come from another model. With ``postings``, a stored
    trigram index of the chunks, only chunks that may match are read. ``only`` names the chunks that may be hits, say those of one
    campaign; statistics stay those of all chunks. ``each_term`` makes every term a lane of its own."""
    readings = readings or {}
    scratch = Scratch(chunks.sparkSession, "search")
    # What several lanes and gates read is written once.
    q = scratch.keep(prepare(queries, table))
    stats = scratch.keep(fulltext.statistics(chunks)) if stats is None else stats
    may = chunks if only is None else chunks.where(only)

    def text_lane(phrases: DataFrame, k: int) -> DataFrame:
        how = {"postings": postings, "stats": stats, "scratch": scratch, "only": only}
        if each_term:
            got = fulltext.match_each(phrases, chunks, **how)
            return got.select("qid", "id", F.lit("fts").alias("lane"), F.col("pos").cast("long").alias("pos"), F.lit(C.WEIGHTS["fts"]).alias("weight"))
        if postings is None:
            got = fulltext.best_scan(phrases, chunks, k, stats=stats, scratch=scratch, only=only)
            return ranking.lane(got, "fts", k, F.desc("score"), F.col("id"))
        return ranking.lane(fulltext.match(phrases, chunks, **how), "fts", k, F.desc("score"), F.col("id"))

    every = terms(q, readings, synonyms).withColumnRenamed("term", "phrase")
    every = scratch.keep(every)
    lanes = scratch.keep(text_lane(every.where(has_hanzi(F.col("phrase"))), C.FTS_LIMIT))
    long = gate(q.where(has_long_run(F.col("q"))), lanes)
    relaxed = terms(long, readings, relaxed=True).where(has_hanzi(F.col("term"))).withColumnRenamed("term", "phrase")
    lanes = lanes.unionByName(text_lane(relaxed, C.FTS_LIMIT))
    n = hanzi_count(F.col("q"))
    by_name = q.where(n.between(1, 12)).select("qid", F.col("q").alias("needle"))
    in_body = q.where(n.between(1, 4)).select("qid", F.col("q").alias("needle"))
    lanes = lanes.unionByName(ranking.like(by_name, may, "index", [F.col("title"), F.to_json("names"), F.col("parent_path")]))
    lanes = lanes.unionByName(ranking.like(in_body, may, "body", [F.col("body")]))
    lanes = scratch.keep(lanes)
    few = gate(q, lanes).select("qid")
    romanised = every.where(~has_hanzi(F.col("phrase"))).join(few, "qid", "left_semi")
    lanes = scratch.keep(lanes.unionByName(text_lane(romanised, C.PINYIN_LIMIT)))
    if query_vectors is not None and vectors is not None:
        own = vectors if only is None else vectors.join(may.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        lanes = lanes.unionByName(vector.semantic_lane(query_vectors, own))
    return ranking.finish(ranking.fuse(lanes), chunks, q, table)


def shown_terms(every: DataFrame) -> DataFrame:
    """(qid, terms) to display: those with ideographs, else all; sorted."""
    d = every.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("all"))
    han = F.filter("all", lambda t: has_hanzi(t))
    return d.select("qid", F.when(F.size(han) > 0, han).otherwise(F.col("all")).alias("terms"))


class Cursor:
    """A place among the hits of one query, moved one by one and kept within them. Hits are the few that a search returns."""

    def __init__(self, hits: DataFrame, qid: int):
        self.rows = hits.where(F.col("qid") == qid).orderBy("rank").limit(C.RETURNED).collect()
        self.at = 0 if self.rows else -1

    def move(self, step: int):
        """The hit that many places on, or the last one in that direction; None if there are no hits."""
        self.at = min(max(self.at + step, 0), len(self.rows) - 1)
        return self.current()

    def current(self):
        return self.rows[self.at] if self.rows else None
