"""Small awkward tables: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

CLASH = ["size", "n", "rep", "key", "mark", "id", "rank", "score", "label", "did", "t", "b", "ord", "row", "a", "c", "copies", "text_", "grp", "word", "_n", "_gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions in the old tower by the sea".split()


def prose(i: int, n: int = 40) -> str:
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1)) % len(WORDS)] + str((i * 31 + j) % 17) for j in range(n))


def rows():
    out = [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, "   \n\t ", None, None, 6), (None, "no id here at all", "en", "s2", 17), (4, "One", "en", "s2", 3),
        (5, prose(5), "en", "s3", 1), (6, prose(5), "en", "s3", 1), (7, prose(5) + " end", "fr", "s1", 1), (8, prose(8), "en", None, 1), (8, prose(8), "en", None, 1),
        (9, " ".join([prose(9, 2000)] * 3), "de", "s2", 1), (10, prose(10) + "\n" + prose(11) + "\n\n" + prose(5), "en", "s1", 1), (11, "a\x0bb c d E", "en", "s4", 1)]
    return out + [(20 + i, prose(20 + i, 60), "en", "s3", 1) for i in range(25)]


def documents(spark, clash: bool = True, empty: bool = False):
    d = spark.createDataFrame([] if empty else rows(), SCHEMA)
    return d.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)]) if clash else d


def clash(df, *more):
    """``df`` with further columns whose names operators use themselves."""
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate([*CLASH, "v", "dim", "tab", "ci", "cj", "chunk", "floor", "shard", "block", "part", "length", "enter", "leave", "m", *more]) if c not in df.columns])
