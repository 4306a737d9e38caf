"""The corpus pipeline: five operators in a row, each a stage that works on all that the one before kept.

quality classifier, line dedup, MinHash near-dedup, mixing sources to target weights, best-fit packing. Each stage's
result is written as Parquet and read again as the next one's documents.

Nulls and edges: a document whose text is null or has no words is scored like any other and, if it stays, has no lines, is near no other,
counts no words, so it comes as often as its source's whole repetitions; a null doc_id is a document like others; rows with one id and equal texts are copies,
and one stays; of different texts with one id all stay or go together as near-duplicates; an empty table gives no rows; extra columns go
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorevane.llm import line_dedup, minhash, mixing, packing, quality
from lorevane.llm.common import table
from lorevane.scratch import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep(spark, docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those that had no others go."""
    return line_dedup.clean(spark, docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, similarity of 0.8 or more; the smallest id stays."""
    return minhash.keep(spark, docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them, whole."""
    return mixing.repeat(docs, Scratch(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [("quality", classify), ("lines", dedup_lines), ("near", dedup_near), ("mix", mix), ("pack", pack)]

#: A trained model and a tokenizer take part, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
