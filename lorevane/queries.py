"""The registered queries, by operator, and the SQL that says the same.

Fixed inputs appear once, as literal rows, and reach both sides through ``literal`` and ``values``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorevane import constants as C
from lorevane.functions import annotate, text, vectors
from lorevane.functions import terms as T
from lorevane.operators import fulltext, maintain, ranking, refine, similarity, vector
from lorevane.plans import searching
from lorevane.scratch import Scratch
from lorevane.sources import blocks, docx, files, llm_json

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], *names: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            # chr() keeps control characters out of the text of the statement.
            body = x.replace("'", "''")
            for c in {c for c in x if ord(c) < 32}:
                body = body.replace(c, f"' || chr({ord(c)}) || '")
            return f"('{body}')"
        return str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ") AS v(" + ", ".join(names) + ")"


# ---------------------------------------------------------------- full text

PHRASES = [("tion",), ("ère",), ("ÉTR",), ("anan",), ("th",), ("ing of",)]
BM25_SQL = f"""
WITH p AS (SELECT p AS phrase, lower(p) AS q, length(p) AS k FROM {values(PHRASES, "p")} WHERE length(p) >= 3),
d AS (SELECT doc_id AS id, lower(source) AS a, lower(text) AS b, greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS size FROM documents),
m AS (
  SELECT p.phrase, d.id, d.size,
    len(list_filter(range(1, length(d.a) - p.k + 2), lambda i: substr(d.a, i, p.k) = p.q)) + len(list_filter(range(1, length(d.b) - p.k + 2), lambda i: substr(d.b, i, p.k) = p.q)) AS f
  FROM d JOIN p ON contains(d.a, p.q) OR contains(d.b, p.q)
), s AS (SELECT count(*) AS n, sum(size) / count(*) AS avgdl FROM d),
g AS (SELECT phrase, count(*) AS df FROM m GROUP BY phrase),
w AS (
  SELECT m.id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avgdl))) AS score
  FROM m JOIN g USING (phrase) CROSS JOIN s GROUP BY m.id
)
"""


def _as_chunks(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("search_text"))


@query(BM25_SQL + "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM w QUALIFY rank <= 50")
def q3_bm25_topk(spark, d):
    chunks = _as_chunks(table(spark, d, "documents"))
    phrases = literal(spark, [(1, p) for (p,) in PHRASES], "qid int, phrase string")
    got = ranking.top(fulltext.match(phrases, chunks, scratch=Scratch(spark, "bm25")), C.FTS_LIMIT, F.desc("score"), F.col("id"))
    return got.select("id", F.round("score", 6).alias("score"), (F.col("pos") + 1).cast("long").alias("rank"))


@query(BM25_SQL + "SELECT id, round(score, 6) AS score FROM w")
def q2_match_by_index(spark, d):
    """The same phrases by way of the trigram index."""
    chunks = _as_chunks(table(spark, d, "documents"))
    phrases = literal(spark, [(1, p) for (p,) in PHRASES], "qid int, phrase string")
    got = fulltext.match(phrases, chunks, postings=fulltext.index(chunks))
    return got.select("id", F.round("score", 6).alias("score"))


@query("""
SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (
  SELECT doc_id, substr(t, i, 3) AS gram, count(*) AS tf FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents) GROUP BY ALL
) GROUP BY gram
""")
def q1_trigram_df(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("search_text"))
    found = fulltext.index(t).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return found.select(fulltext.spelled("gram").alias("gram"), "df", "tf")


@query("""SELECT count(*) AS n, round(sum(greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0)) / count(*), 6) AS avgdl FROM documents""")
def a16_corpus_statistics(spark, d):
    return fulltext.statistics(_as_chunks(table(spark, d, "documents"))).select("n", F.round("avgdl", 6).alias("avgdl"))


NEEDLES = [(1, "SRC1"), (2, "Ère"), (3, "the"), (4, "100%"), (5, "a_b")]
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like_sql(columns: list[str], weight: float) -> str:
    test = " OR ".join(f"contains({LOWER_SQL.format(c)}, {LOWER_SQL.format('q.needle')})" for c in columns)
    return f"""
SELECT q.qid AS qid, doc_id AS id, row_number() OVER (PARTITION BY q.qid ORDER BY doc_id) - 1 AS pos, {weight}::DOUBLE AS weight
FROM documents JOIN (SELECT CAST(a AS BIGINT) AS qid, b AS needle FROM {values(NEEDLES, "a", "b")}) q ON {test} QUALIFY pos < 40"""


def _needles(spark):
    return literal(spark, NEEDLES, "qid long, needle string")


@query(_like_sql(["source", "lang"], 2.4))
def f2_like_scan(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return ranking.like(_needles(spark), t, "index", [F.col("source"), F.col("lang")]).drop("lane")


@query(_like_sql(["text"], 0.35))
def f3_like_body(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return ranking.like(_needles(spark), t, "body", [F.col("text")]).drop("lane")


# ---------------------------------------------------------------- fusion and ranking

LANES_SQL = """
lanes AS (
  SELECT item_id AS qid, doc_id AS id, 'body' AS lane, 0.35 AS weight, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS pos
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  UNION ALL
  SELECT item_id, doc_id, 'fts', 1.0, row_number() OVER (PARTITION BY item_id ORDER BY abs(n_chars - length(b.text)), doc_id) - 1
  FROM benchmark b JOIN documents d ON d.n_chars BETWEEN length(b.text) - 20 AND length(b.text) + 20
), top AS (SELECT * FROM lanes WHERE pos < CASE lane WHEN 'body' THEN 40 ELSE 50 END),
fused AS (
  SELECT qid, id, sum(weight / (60.0 + pos + 1)) AS rrf, CASE WHEN bool_or(lane = 'fts') AND bool_or(lane = 'body') THEN 'fts,body' ELSE min(lane) END AS via FROM top GROUP BY qid, id
)"""


def _holds(spark, d, *texts: str) -> DataFrame:
    """(qid, id): the documents that hold a benchmark text in one of these columns."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("needle"))
    t = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return fulltext.find_all(t, b, *[F.col(x) for x in texts]).join(b, "needle").select("qid", "id")


def _lanes(spark, d) -> DataFrame:
    inside = _holds(spark, d, "text")
    # Lengths up to 20 characters away, as values to join by.
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.length("text").alias("n"))
    b = b.select("qid", "n", F.explode(F.sequence(F.col("n") - 20, F.col("n") + 20)).alias("n_chars"))
    near = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars").join(b, "n_chars").select("qid", "id", F.abs(F.col("n_chars") - F.col("n")).alias("far"))
    return ranking.lane(inside, "body", C.LIKE_LIMIT, F.col("id")).unionByName(ranking.lane(near, "fts", C.FTS_LIMIT, F.col("far"), F.col("id")))


@query(f"WITH {LANES_SQL} SELECT qid, id, round(rrf, 9) AS rrf, via, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM fused QUALIFY rank <= 40")
def a4_rrf_fusion(spark, d):
    got = ranking.top(ranking.fuse(_lanes(spark, d)), C.FUSED, F.desc("rrf"), F.col("id"))
    return got.select("qid", "id", F.round("rrf", 9).alias("rrf"), F.array_join("via", ",").alias("via"), (F.col("pos") + 1).cast("long").alias("rank"))


BOOST_SQL = """CASE WHEN q = '' THEN 0.0 WHEN title = q THEN 12.0 WHEN contains(title, q) THEN 8.0
  WHEN contains(body, q) THEN 4.0 * ((length(body) - length(replace(body, q, ''))) // length(q)) / (1.0 + greatest(length(body), 1) / 160.0) ELSE 0.0 END"""
SPACES = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _normal_sql(c: str, table_: tuple[str, str] = ("", "")) -> str:
    a, b = table_[0] + text.WIDE, table_[1] + text.NARROW
    return f"trim(regexp_replace(translate({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}'), '{SPACES}+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, source AS title, {_normal_sql('text')} AS body FROM documents), b AS (SELECT item_id, {_normal_sql('text')} AS q FROM benchmark)
SELECT item_id, doc_id, round({BOOST_SQL}, 9) AS boost FROM d JOIN b ON contains(body, q) OR contains(title, q)
""")
def x25_contains_boost(spark, d):
    b = table(spark, d, "benchmark").select("item_id", text.normalize(F.col("text")).alias("needle"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), text.normalize(F.col("text")).alias("body"))
    hit = fulltext.find_all(t, b, F.col("title"), F.col("body")).drop("n").join(b, "needle").join(t, "id")
    score = ranking.boost(F.col("title"), F.col("body"), F.array().cast("array<string>"), F.col("needle"))
    return hit.select("item_id", F.col("id").alias("doc_id"), F.round(score, 9).alias("boost"))


@query(f"""
WITH {LANES_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS r FROM fused QUALIFY r <= 40),
h AS (SELECT best.*, source AS title, {_normal_sql('text')} AS body FROM best JOIN documents ON doc_id = id),
u AS (SELECT *, row_number() OVER (PARTITION BY qid, lang_doc, title ORDER BY rrf DESC, id) AS k FROM (SELECT h.*, id % 7 AS lang_doc FROM h) QUALIFY k = 1),
s AS (SELECT u.qid, u.id, u.title, u.via, q, u.body, contains(u.title, q) AS named, rrf + {BOOST_SQL} AS score FROM u JOIN (SELECT item_id, {_normal_sql('text')} AS q FROM benchmark) b ON item_id = qid)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY named DESC, score DESC, encode(title), id) AS rank, id, round(score, 9) AS score, via FROM s QUALIFY rank <= 20
""")
def w3_final_rank(spark, d):
    """Fused hits through dedup, boost and the final order."""
    t = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"),
        F.array().cast("array<string>").alias("names"), F.lit(C.SOURCE_RANK).alias("source_rank"))
    q = searching.prepare(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    got = ranking.finish(ranking.fuse(_lanes(spark, d)), t, q)
    return got.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"), F.array_join("via", ",").alias("via"))


TERMS_SQL = r"""
n AS (SELECT item_id, text AS q FROM benchmark),
w AS (SELECT item_id, unnest(regexp_extract_all(q, '[A-Za-z0-9]+')) AS x, unnest(range(len(regexp_extract_all(q, '[A-Za-z0-9]+')))) AS i FROM n),
f AS (SELECT item_id, lower(x) AS t, 80 AS weight, min(i) AS i FROM w WHERE length(x) >= 3 GROUP BY item_id, lower(x)),
e AS (
  SELECT * FROM f
  UNION ALL SELECT item_id, regexp_replace(q, '[^A-Za-z0-9]', '', 'g'), 95, 1000000 FROM n WHERE length(regexp_replace(q, '[^A-Za-z0-9]', '', 'g')) >= 3
  UNION ALL SELECT item_id, trim(regexp_replace(q, '\s+', ' ', 'g')), 90, 1000001 FROM n WHERE contains(q, ' ')
), k AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, strlen(t), i) AS rank FROM e)
"""
# Only where a phrase overlaps itself does the plain count fall short.
_COUNT = "CASE WHEN len(list_filter(twice, lambda x: contains({0}, x))) > 0 THEN len(list_filter(range(1, length({0}) - length(q) + 2), lambda i: substr({0}, i, length(q)) = q)) ELSE (length({0}) - length(replace({0}, q, ''))) // length(q) END"


def _hybrid_sql(k: int, k_each: int | None = None) -> str:
    """Benchmark texts have no ideographs, so all that runs is the lane of plain terms. With k_each every term is a lane."""
    best = f"""
r AS (SELECT qid, id, round(sum(part), 9) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(sum(part), 9) DESC, id) AS pos FROM hit GROUP BY qid, id QUALIFY pos <= {k}),
fused AS (SELECT qid, id, 1.0 / (60.0 + pos) AS rrf FROM r)""" if k_each is None else f"""
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid, q ORDER BY round(part, 9) DESC, id) AS pos FROM hit QUALIFY pos <= {k_each}),
fused0 AS (SELECT qid, id, sum(1.0 / (60.0 + pos)) AS rrf FROM r GROUP BY qid, id),
fused AS (SELECT * FROM fused0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, id) <= 40)"""
    return f"""
WITH {TERMS_SQL}, terms AS (SELECT DISTINCT item_id AS qid, t AS phrase, lower(t) AS q FROM k WHERE rank <= 48 AND length(t) >= 3),
p AS (SELECT DISTINCT q, list_transform(list_filter(range(1, length(q)), lambda j: left(q, j) = right(q, j)), lambda j: q || substr(q, j + 1)) AS twice FROM terms),
d AS (SELECT doc_id AS id, lower(source) AS a, lower(source || chr(10) || text) AS b, greatest(length(source) - 2, 0) + greatest(length(source) + 1 + length(text) - 2, 0) AS size FROM documents),
m AS (SELECT p.q, d.id, d.size, {_COUNT.format("d.a")} + {_COUNT.format("d.b")} AS f FROM d JOIN p ON contains(d.b, p.q)),
st AS (SELECT count(*) AS n, sum(size) / count(*) AS avgdl FROM d), g AS (SELECT q, count(*) AS df FROM m GROUP BY q),
sc AS (SELECT m.q, m.id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avgdl)) AS part FROM m JOIN g USING (q) CROSS JOIN st),
hit AS (SELECT terms.qid, sc.id, sc.q, sc.part FROM terms JOIN sc USING (q)), {best},
h AS (SELECT fused.*, source AS title, {_normal_sql("d.text")} AS body, {_normal_sql("b.text")} AS q FROM fused JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = qid),
o AS (SELECT *, contains(title, q) AS named, rrf + {BOOST_SQL} AS score FROM h)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY named DESC, round(score, 12) DESC, encode(title), id) AS rank, id, round(score, 6) AS score, 'fts' AS via FROM o QUALIFY rank <= 20
"""


def _search_input(spark, d) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "doc_id", F.col("source").alias("title"), F.col("text").alias("body"), F.array().cast("array<string>").alias("names"),
        F.col("source").alias("parent_path"), F.lit(C.SOURCE_RANK).alias("source_rank"), F.concat_ws("\n", "source", "text").alias("search_text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), t


def _hits(got: DataFrame) -> DataFrame:
    return got.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), F.array_join("via", ",").alias("via"))


@query(_hybrid_sql(C.PINYIN_LIMIT))
def q_hybrid_search(spark, d):
    """Every benchmark text as a query against all documents, through the whole read path."""
    return _hits(searching.search(*_search_input(spark, d)))


@query(_hybrid_sql(C.PINYIN_LIMIT, C.TERM_FALLBACK_LIMIT))
def q4_each_term(spark, d):
    """The same with every term a lane of its own."""
    return _hits(searching.search(*_search_input(spark, d), each_term=True))


@query(BM25_SQL + "SELECT id, round(score, 6) AS score FROM w JOIN documents ON doc_id = id WHERE lang = 'en'")
def f1_scope(spark, d):
    """Hits of one campaign only (here: of one language), with the frequencies of all chunks."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("search_text"), F.col("lang").alias("campaign"))
    phrases = literal(spark, [(1, p) for (p,) in PHRASES], "qid int, phrase string")
    got = fulltext.match(phrases, chunks, scratch=Scratch(spark, "scope"), only=F.col("campaign") == "en")
    return got.select("id", F.round("score", 6).alias("score"))


@query("""
SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY n_chars DESC, doc_id) = 1
""")
def a8_dedup_title(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars", F.lit(0).alias("qid"), F.col("lang").alias("doc_id"), F.col("text").alias("ntitle"), F.col("n_chars").alias("rrf"))
    return ranking.dedup_titles(t).select(F.col("id").alias("doc_id"), "source", "n_chars")


@query("""
WITH h AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS rank FROM h),
t AS (SELECT qid, min(id) AS id FROM h GROUP BY qid)
SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.qid = t.qid AND r.id = t.id AND rank <= 10) THEN 1 ELSE 0 END), 9) AS recall FROM t
""")
def a15_recall_at_k(spark, d):
    hit = Scratch(spark, "recall").keep(_holds(spark, d, "text"))
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("id"))))
    relevant = hit.groupBy("qid").agg(F.min("id").alias("id"))
    return ranking.recall(ranked, relevant).select(F.round("recall", 9).alias("recall"))


# ---------------------------------------------------------------- vectors

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""
SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round({_DOT}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 QUALIFY rank <= 50
""")
def w4_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    got = vector.top_chunks(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))
    got = got.withColumn("score", F.round("score", 9))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return got.select("qid", "chunk_id", "score", F.row_number().over(w).cast("long").alias("rank"))


@query(f"SELECT a.vec_id AS qid, b.label::BIGINT AS chunk_id, round(max({_DOT}), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 GROUP BY ALL")
def a3_best_part(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    got = vector.best_parts(q, e.select(F.col("label").cast("long").alias("chunk_id"), F.col("embedding").alias("v")))
    return got.select("qid", "chunk_id", F.round("score", 9).alias("score"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 4 * x * x))), 6) AS before,
  round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS after FROM embeddings
""")
def x27_l2_normalize(spark, d):
    double = F.transform("embedding", lambda x: x.cast("double") * 2)
    norm = lambda v: F.sqrt(vectors.dot(v, v))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(double), 6).alias("before"), F.round(norm(vectors.l2_normalize(double)), 6).alias("after"))


@query("SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings")
def x28_blob_round_trip(spark, d):
    e = table(spark, d, "embeddings").withColumn("b", vectors.to_blob("embedding"))
    back = vectors.from_blob("b")
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("vec_id", F.length("b").cast("long").alias("bytes"), F.round(total, 9).alias("total"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def j3_missing_vectors(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return vector.missing(chunks, table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))).select(F.col("id").alias("doc_id"))


@query("SELECT vec_id AS chunk_id, label AS seq FROM embeddings QUALIFY bool_and(vec_id % 97 <> 0) OVER (PARTITION BY vec_id)")
def k5_all_or_none(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("seq"), F.when(F.col("vec_id") % 97 != 0, F.col("embedding")).alias("v"))
    return vector.all_or_none(e).select("chunk_id", "seq")


# ---------------------------------------------------------------- formats

_HEADS = "'(?is)<h([1-4])[^>]*>(.*?)</h[1-4]>'"
_TAGS_SQL = "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>'"
_WHITE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The texts between headings, and each heading's level and text, put together again.
_MARKED = f"""list_reduce(list_transform(range(1, len(regexp_split_to_array(html, {_HEADS})) + 1), lambda i:
  regexp_replace(regexp_split_to_array(html, {_HEADS})[i], {_TAGS_SQL}, ' ', 'g') || CASE WHEN i <= len(regexp_extract_all(html, {_HEADS}))
    THEN chr(10) || repeat('#', CAST(regexp_extract_all(html, {_HEADS}, 1)[i] AS INTEGER)) || ' '
      || regexp_replace(regexp_replace(regexp_extract_all(html, {_HEADS}, 2)[i], {_TAGS_SQL}, ' ', 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g') || chr(10) ELSE '' END), lambda x, y: x || y)"""


@query(f"SELECT page_id, sha256({_MARKED}) AS text_sha256 FROM pages")
def s7_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(blocks.html_text(F.col("html")), 256).alias("text_sha256"))


_STRIP = lambda c: f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


@query(f"""
WITH t AS (SELECT page_id, string_split({_MARKED}, chr(10)) AS ls FROM pages),
l AS (SELECT page_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM t),
h AS (SELECT *, regexp_replace(x, '{SPACES}+$', '') AS r, regexp_matches(regexp_replace(x, '{SPACES}+$', ''), '^#{{1,4}}[ \\t]') AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS grp FROM h),
b AS (
  SELECT page_id, grp, max(CASE WHEN head THEN length(regexp_extract(r, '^#{{1,4}}')) END) AS lv, max(CASE WHEN head THEN {_STRIP("regexp_replace(" + _STRIP("regexp_replace(r, '^#{1,4}', '')") + ", '#+$', '')")} END) AS title,
    {_STRIP("coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT head), '')")} AS body FROM g GROUP BY page_id, grp
)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY grp) - 1 AS block, coalesce(lv, 1)::BIGINT AS level, coalesce(title, '文档') AS title, sha256(body) AS body_sha256 FROM b WHERE body <> ''
""")
def s5_markdown_blocks(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(blocks.heading_blocks(blocks.html_text(F.col("html")))).alias("block", "b"))
    return p.select("page_id", F.col("block").cast("long").alias("block"), F.col("b.heading_level").cast("long").alias("level"), F.col("b.title").alias("title"), F.sha2("b.text", 256).alias("body_sha256"))


def _cut(spark, d, f) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.posexplode(f).alias("i", "part"))
    return t.select("doc_id", F.col("i").cast("long").alias("i"), "part")


# Cutting goes from left to right, so the SQL is recursive: a row for each step of each text.
_HAN = "[一-鿿㐀-䶿]"
_RSTRIP = lambda c: f"regexp_replace({c}, '{SPACES}+$', '')"
_LSTRIP = lambda c: f"regexp_replace({c}, '^{SPACES}+', '')"


@query(f"""
WITH RECURSIVE r(doc_id, ls, i, buf, emit) AS (
  SELECT doc_id, string_split(text, chr(10)), 0, '', CAST(NULL AS VARCHAR) FROM documents
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN p = '' THEN CASE WHEN enough THEN '' ELSE buf || chr(10) END WHEN length(more) >= 2000 THEN '' ELSE more END,
    CASE WHEN p = '' THEN CASE WHEN enough THEN buf END WHEN length(more) >= 2000 THEN more END
  FROM (
    SELECT *, len(regexp_extract_all(buf, '{_HAN}')) > 80 OR length(buf) > 200 AS enough, CASE WHEN buf = '' THEN p ELSE buf || chr(10) || p END AS more
    FROM (SELECT *, {_RSTRIP('ls[i + 1]')} AS p FROM r WHERE i < len(ls)))
), e AS (SELECT doc_id, i, emit AS x FROM r WHERE emit IS NOT NULL UNION ALL SELECT doc_id, i + 1, buf FROM r WHERE i = len(ls) AND {_STRIP('buf')} <> ''),
f AS (SELECT * FROM e UNION ALL SELECT doc_id, 0, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, x FROM f WHERE {_STRIP('x')} <> '')
SELECT doc_id, i, CASE WHEN substr({_normal_sql('x')}, 1, 40) = '' THEN '段落' || (i + 1) ELSE substr({_normal_sql('x')}, 1, 40) END AS title, length(x) AS n, sha1(x) AS sha FROM g
""")
def s6_plain_blocks(spark, d):
    t = _cut(spark, d, blocks.plain(F.col("text")))
    return t.select("doc_id", "i", F.col("part.title").alias("title"), F.length("part.text").cast("long").alias("n"), F.sha1(F.col("part.text").cast("binary")).alias("sha"))


def _overlapped_sql(source: str) -> str:
    """CTEs from source (key, text) to parts (key, i, part) of long texts."""
    over = "acc <> '' AND length(acc) + length(ls[i + 1]) > 900"
    return f"""
src AS ({source}), r(key, ls, i, acc, emit) AS (
  SELECT key, string_split(text, chr(10)), 0, '', CAST(NULL AS VARCHAR) FROM src WHERE length(text) > 900
  UNION ALL
  SELECT key, ls, i + 1, CASE WHEN {over} THEN right(acc, 40) ELSE acc END || ls[i + 1] || chr(10), CASE WHEN {over} THEN {_STRIP('acc')} END FROM r WHERE i < len(ls)
), e AS (
  SELECT key, i, emit AS part FROM r WHERE emit IS NOT NULL UNION ALL SELECT key, i + 1, {_STRIP('acc')} FROM r WHERE i = len(ls) AND {_STRIP('acc')} <> ''
  UNION ALL SELECT key, 0, text FROM src WHERE length(text) <= 900
), parts AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS i, part FROM e)"""


@query(f"WITH RECURSIVE {_overlapped_sql('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, i, length(part) AS n, sha1(part) AS sha FROM parts")
def s8_long_blocks(spark, d):
    t = _cut(spark, d, blocks.split_long(F.col("text")))
    return t.select("doc_id", "i", F.length("part").cast("long").alias("n"), F.sha1(F.col("part").cast("binary")).alias("sha"))


def _window_end(start: str) -> str:
    ended = f"length(regexp_extract(substr(text, {start} + 1, 400), '(?s)^.{{200,399}}[。！？；\\n]'))"
    return f"CASE WHEN {start} + 400 >= n THEN n WHEN {ended} > 0 THEN {start} + {ended} ELSE {start} + 400 END"


def _windows_sql(source: str) -> str:
    """CTEs from source (key, text) to windows (key, i, part)."""
    nxt = "greatest(e - 50, s + 1)"
    return f"""
src AS ({source}), w(key, text, n, s, e) AS (
  SELECT key, text, n, 0::BIGINT, {_window_end('0')} FROM (SELECT key, text, length(text) AS n FROM src)
  UNION ALL SELECT key, text, n, {nxt}, {_window_end(nxt)} FROM w WHERE e < n
), windows AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS i, part FROM (SELECT key, s, {_STRIP('substr(text, s + 1, e - s)')} AS part FROM w) WHERE part <> '')"""


@query(f"WITH RECURSIVE {_windows_sql('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, i, length(part) AS n, sha1(part) AS sha FROM windows")
def x17_windows(spark, d):
    t = _cut(spark, d, vector.windows(F.col("text")))
    return t.select("doc_id", "i", F.length("part").cast("long").alias("n"), F.sha1(F.col("part").cast("binary")).alias("sha"))


_SEGMENTS_SQL = f"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents),
from_ AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
g(doc_id, a, rest) AS (
  SELECT doc_id, CAST(a + length(x) - length({_LSTRIP('x')}) AS BIGINT), {_STRIP('x')} FROM from_ WHERE {_STRIP('x')} <> ''
  UNION ALL SELECT doc_id, a + cut, substr(rest, cut + 1) FROM (SELECT *, {{cut}} AS cut FROM g) WHERE length(rest) > cut
), seg AS (
  SELECT doc_id, a + length(y) - length({_LSTRIP('y')}) AS a, {_STRIP('y')} AS y FROM (SELECT doc_id, a, substr(rest, 1, {{cut}}) AS y FROM g) WHERE {_STRIP('y')} <> ''
), segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, a, y FROM seg)""".replace(
    "{cut}", "CASE WHEN length(rest) <= 500 THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(rest, '(?s)^.{250,500}[。！？；]')), 0), 500) END")


@query(f'WITH RECURSIVE {_SEGMENTS_SQL} SELECT doc_id, i, a AS "offset", length(y) AS len FROM segs')
def x18_segments(spark, d):
    t = _cut(spark, d, refine.segments_udf("text"))
    return t.select("doc_id", "i", F.col("part.offset").cast("long").alias("offset"), F.col("part.len").cast("long").alias("len"))


# Neighbouring pieces share one segment; two segments always fit into a piece.
_PIECES_SQL = f"""{_SEGMENTS_SQL},
k(doc_id, i, first, size, a, b) AS (
  SELECT doc_id, i, i, length(y) + 8, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM segs WHERE i = 0
  UNION ALL
  SELECT k.doc_id, n.i, CASE WHEN past THEN greatest(k.i, first + 1) ELSE first END, length(n.y) + 8 + CASE WHEN NOT past THEN size WHEN k.i > first THEN length(o.y) + 8 ELSE 0 END,
    CASE WHEN past THEN first END, CASE WHEN past THEN k.i END
  FROM k JOIN segs n ON n.doc_id = k.doc_id AND n.i = k.i + 1 JOIN segs o ON o.doc_id = k.doc_id AND o.i = k.i, LATERAL (SELECT size + length(n.y) + 8 > 3200 AS past)
), last AS (SELECT doc_id, max(i) AS i FROM segs GROUP BY doc_id),
piece AS (SELECT doc_id, a, b FROM k WHERE a IS NOT NULL UNION ALL SELECT k.doc_id, first, k.i FROM k JOIN last ON last.doc_id = k.doc_id AND last.i = k.i)"""


@query(f"""
WITH RECURSIVE {_PIECES_SQL}
SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.a) - 1 AS i, p.a AS first_seg, p.b AS last_seg,
  sha1(string_agg('[' || CASE WHEN s.i < 1000 THEN lpad(CAST(s.i AS VARCHAR), 3, '0') ELSE CAST(s.i AS VARCHAR) END || '] ' || s.y || chr(10), '' ORDER BY s.i)) AS sha
FROM piece p JOIN segs s ON s.doc_id = p.doc_id AND s.i BETWEEN p.a AND p.b GROUP BY p.doc_id, p.a, p.b
""")
def x19_pieces(spark, d):
    t = _cut(spark, d, refine.pieces_udf("text"))
    return t.select("doc_id", "i", F.col("part.first_seg").cast("long").alias("first_seg"), F.col("part.last_seg").cast("long").alias("last_seg"), F.sha1(F.col("part.text").cast("binary")).alias("sha"))


@query()
def i5_refined_drafts(spark, d):
    """Plain texts through blocks, rules, keys and lead-ins."""
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("stem"), F.posexplode(blocks.coalesce_titles(blocks.plain(F.col("text")))).alias("block", "x"))
    b = t.select("doc_id", "stem", "block", F.col("x.heading_level").alias("level"), F.col("x.title").alias("title"), F.col("x.text").alias("text"))
    out, _ = refine.drafts(b, scratch=Scratch(spark, "drafts"))
    return out.select("doc_id", "ordinal", "stable_key", "alt_anchor", "content_hash", "entity_type", "title", "visibility", F.array_join("names", ",").alias("names"))


FILE_PATH = """source || '/' || CASE doc_id % 4 WHEN 0 THEN 'a.b/' WHEN 1 THEN 'x y/' ELSE '' END || CASE WHEN doc_id % 13 = 5 THEN '' ELSE lang || doc_id END
  || CASE doc_id % 12 WHEN 0 THEN '.MD' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.PNG' WHEN 4 THEN '' WHEN 5 THEN '.htm' WHEN 6 THEN '.rtf' WHEN 7 THEN '.pdf' WHEN 8 THEN '.txt' WHEN 9 THEN '.markdown' WHEN 10 THEN '.html' ELSE '.' END"""


@query(f"""
SELECT doc_id, CASE WHEN e IN ('md', 'markdown', 'html', 'htm', 'txt', 'rtf', 'docx') THEN 'doc' WHEN e IN ('pdf', 'doc') THEN 'unsupported' ELSE 'skip' END AS class, e AS ext
FROM (SELECT doc_id, lower(regexp_extract(p, '[^/\\\\]\\.([A-Za-z0-9]+)$', 1)) AS e FROM (SELECT doc_id, {FILE_PATH} AS p FROM documents))
""")
def s2_classify(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(FILE_PATH).alias("path"))
    return t.select("doc_id", files.classify(F.col("path")).alias("class"), files.extension(F.col("path")).alias("ext"))


@query("SELECT doc_id, sha256(text) AS text_sha256, true AS same FROM documents")
def s3_decode(spark, d):
    """Texts as bytes and back, and their GB18030 form where it isn't UTF-8."""
    from lorevane.session import configure

    configure(spark)
    t = table(spark, d, "documents")
    gb = files.decode(F.encode("text", "GB18030"))
    same = (gb == F.col("text")) | F.is_valid_utf8(F.encode("text", "GB18030").cast("string"))
    return t.select("doc_id", F.sha2(files.decode(F.col("text").cast("binary")), 256).alias("text_sha256"), same.alias("same"))


# The place of a page below its site, below another one whose name begins alike, and in Windows' spelling.
ROOT = "CASE page_id % 4 WHEN 0 THEN split_part(url, '/', 1) || '//' || split_part(url, '/', 3) WHEN 1 THEN split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/' WHEN 2 THEN substr(url, 1, length(url) - 3) ELSE 'C:' || chr(92) || 'in' END"
PAGE_PATH = "CASE page_id % 4 WHEN 3 THEN 'C:' || chr(92) || 'in' || chr(92) || replace(url, '/', chr(92)) ELSE url END"


@query(f"""
SELECT page_id, CASE WHEN starts_with(p2, r2 || '/') THEN substr(p2, length(r2) + 2) ELSE regexp_extract(p2, '[^/]*$') END AS rel
FROM (SELECT page_id, replace(p, '\\', '/') AS p2, regexp_replace(replace(r, '\\', '/'), '/+$', '') AS r2 FROM (SELECT page_id, {ROOT} AS r, {PAGE_PATH} AS p FROM pages))
""")
def s1_relative_paths(spark, d):
    t = table(spark, d, "pages").select("page_id", F.expr(ROOT).alias("root"), F.expr(PAGE_PATH).alias("path"))
    return t.select("page_id", annotate.relative_path(F.col("path"), F.col("root")).alias("rel"))


# Replies around the documents' sources: fenced, wrapped, with prose around, with none.
REPLY = """CASE doc_id % 5
  WHEN 0 THEN '```json' || chr(10) || '[{"title":" ' || source || ' ","aliases":["' || lang || '"," ' || source || ' ",""],"entity_type":"item","start":"[' || doc_id || ']","end":4}]' || chr(10) || '```'
  WHEN 1 THEN '{"entries":[{"title":"' || lang || '","start":' || doc_id || ',"heading_level":9},{"title":"  "}]}'
  WHEN 2 THEN 'Sure: [{"title":"' || source || '","start":"x","entity_type":"dragon"},{"title":"' || lang || '","start":"' || doc_id || '"}] done'
  WHEN 3 THEN text ELSE '[]' END"""


@query("""
SELECT doc_id, source AS title, lang AS names, 'item' AS kind, doc_id AS start, 2::BIGINT AS heading_level FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, lang, '', '', doc_id, 2 FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, source, '', '', -1, 2 FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, lang, '', '', doc_id, 2 FROM documents WHERE doc_id % 5 = 2
""")
def s14_llm_replies(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(llm_json.parse_entries(F.expr(REPLY))).alias("e"))
    return t.select("doc_id", "e.title", F.array_join("e.aliases", ",").alias("names"), F.col("e.entity_type").alias("kind"), "e.start", F.col("e.heading_level").cast("long").alias("heading_level"))


NUMBER = """CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR(30)) WHEN 1 THEN '[00' || doc_id || ']' WHEN 2 THEN text WHEN 3 THEN '' WHEN 4 THEN doc_id || '99999999999999999999' ELSE lang || doc_id || ' of 30' END"""


@query(f"SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(a, '[0-9]+'), '') AS BIGINT), -1) AS n FROM (SELECT doc_id, {NUMBER} AS a FROM documents)")
def s15_flexible_int(spark, d):
    return table(spark, d, "documents").select("doc_id", llm_json.flexible_int(F.expr(NUMBER)).alias("n"))


# Each document as a Word document: a heading by style, its lines as paragraphs with breaks in them, deleted text, a table, a heading by outline.
_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RUN = "'<w:r><w:t xml:space=\"preserve\">' || {} || '</w:t></w:r>'"
WORD_XML = f"""'<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading' || (doc_id % 4 + 1) || '"/></w:pPr>' || {_RUN.format(_XML.format('source'))} || '</w:p><w:p w:rsidR="1">'
  || {_RUN.format("'The whole text of a document, with its lines: ' || replace(" + _XML.format("text") + ", chr(10), '</w:t></w:r></w:p><w:p><w:r><w:t>The next line of that document, which goes: ')")}
  || '<w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:instrText>PAGE</w:instrText></w:r></w:p><w:tbl><w:tr><w:tc><w:p>' || {_RUN.format("'k'")} || '</w:p></w:tc><w:tc><w:p>' || {_RUN.format("'value ' || lang")}
  || '</w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p>' || {_RUN.format("'one'")} || '</w:p></w:tc><w:tc><w:p>' || {_RUN.format("'two'")} || '</w:p></w:tc><w:tc><w:p>' || {_RUN.format("lang")} || '</w:p></w:tc></w:tr></w:tbl>'
  || '<w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr>' || {_RUN.format("'Next ' || doc_id")} || '</w:p><w:p>' || {_RUN.format("'first part of a line that is no heading at all' || '<w:br/>' || 'and more of ' || lang")} || '</w:p></w:body></w:document>'"""
# A paragraph in which "<" stands has its tags, and only then runs of blanks, taken out.
_PARA = lambda c: f"CASE WHEN contains({c}, '<') THEN trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{SPACES}+', ' ', 'g')) ELSE {_STRIP(c)} END"
_WORD_SOURCE = f"""
SELECT doc_id * 2 AS key, {_STRIP("string_agg(x, chr(10) ORDER BY i) || chr(10) || 'k：value ' || any_value(lang) || chr(10) || 'one / two / ' || any_value(lang)")} AS text
FROM (SELECT doc_id, lang, i, {_PARA('y')} AS x FROM (
  SELECT doc_id, lang, CASE WHEN i = 0 THEN 'The whole text of a document, with its lines: ' ELSE 'The next line of that document, which goes: ' END || x AS y, i
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))) GROUP BY doc_id
UNION ALL SELECT doc_id * 2 + 1, 'first part of a line that is no heading at all' || chr(10) || 'and more of ' || lang FROM documents"""


@query(f"""
WITH RECURSIVE {_overlapped_sql(_WORD_SOURCE)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY key, i) - 1 AS block, CASE WHEN key % 2 = 0 THEN doc_id % 4 + 1 ELSE 1 END AS level,
  CASE WHEN key % 2 = 0 THEN source ELSE 'Next ' || doc_id END AS title, sha1(part) AS sha FROM parts JOIN documents ON doc_id = key // 2
""")
def s9_docx_blocks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(docx.blocks_from_xml(F.expr(WORD_XML))).alias("block", "b"))
    return t.select("doc_id", F.col("block").cast("long").alias("block"), F.col("b.heading_level").cast("long").alias("level"), F.col("b.title").alias("title"), F.sha1(F.col("b.text").cast("binary")).alias("sha"))


# ---------------------------------------------------------------- scalars

RAW_TEXTS = [(1, "　ＡＢＣ　１２３！ "), (2, "獨眼\u00a0酒保\n\n老格"), (3, "a\u2003b\tc  d"), (4, ""), (5, "𠀀 x"), (6, "ﾊﾛｰ 斷橋")]
SOME_PAIRS = ("獨斷橋", "独断桥")


@query(f"""
SELECT CAST(a AS BIGINT) AS id, {_normal_sql("b", SOME_PAIRS)} AS norm, CAST(len(regexp_extract_all(b, '[一-鿿㐀-䶿]')) AS BIGINT) AS hanzi FROM {values(RAW_TEXTS, "a", "b")}
UNION ALL SELECT doc_id + 1000, sha256({_normal_sql("text", SOME_PAIRS)}), 0 FROM documents
""")
def x1_normalize(spark, d):
    a = literal(spark, RAW_TEXTS, "id long, t string").select("id", text.normalize(F.col("t"), SOME_PAIRS).alias("norm"), text.hanzi_count(F.col("t")).cast("long").alias("hanzi"))
    b = table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.sha2(text.normalize(F.col("text"), SOME_PAIRS), 256).alias("norm"), F.lit(0).cast("long").alias("hanzi"))
    return a.unionByName(b)


_N = _normal_sql


@query(f"""
SELECT doc_id, sha1({_N('source')} || '|' || {_N('lang')}) AS stable_key, sha1({_N('source')} || '|' || {_N('lang')} || '|' || doc_id) AS again_key,
  sha1({_N('source')} || '|' || substr({_N('text')}, 1, 80)) AS alt_anchor, sha1('body:' || text) AS body_hash, sha256(text) AS file_hash FROM documents
""")
def x7_hash_keys(spark, d):
    s, l, t = F.col("source"), F.col("lang"), F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", annotate.stable_key(s, l).alias("stable_key"), annotate.stable_key(s, l, ordinal=F.col("doc_id")).alias("again_key"),
        annotate.alt_anchor(s, t).alias("alt_anchor"), annotate.body_hash(t).alias("body_hash"), annotate.file_hash(t.cast("binary")).alias("file_hash"))


# Entries and questions made of the documents, by expressions that both engines read. Vowels become ideographs.
_HANZI_OF = "translate({}, 'aeiou', '灰港铁门格')"
ENTRY_TITLE = f"""CASE doc_id % 6 WHEN 0 THEN {_HANZI_OF.format('source')} || '（' || lang || '）' WHEN 1 THEN '灰港 ' || {_HANZI_OF.format('substr(text, 1, 9)')}
  WHEN 2 THEN '铁门 Gate of Ash' WHEN 3 THEN source WHEN 4 THEN '第' || doc_id || '章' ELSE 'x(' || {_HANZI_OF.format('substr(text, 1, 30)')} || ')' END"""
ENTRY_BODY = f"""CASE doc_id % 7 WHEN 0 THEN '又名：' || source || '、' || lang || '；' || substr(text, 1, 5) || chr(10) || text WHEN 1 THEN '【秘密】它是' || source || chr(10) || text
  WHEN 2 THEN 'DM only: keep' || chr(10) || text WHEN 3 THEN '【DM】' || source WHEN 4 THEN '一个组织，港口都有 ' || text || chr(10) || '亦称: ' || lang || ',' || source
  WHEN 5 THEN {_HANZI_OF.format('text')} || ' 对玩家隐藏' ELSE '人物。' || text END"""
QUESTION = f"CASE item_id % 4 WHEN 0 THEN {_HANZI_OF.format('text')} WHEN 1 THEN replace({_HANZI_OF.format('text')}, ' ', '') WHEN 2 THEN substr(text, 1, 7) || ' 老格 2024' ELSE '在' || {_HANZI_OF.format('lower(text)')} || '的' END"
ENTRIES_SQL = f"(SELECT doc_id AS a, {ENTRY_TITLE} AS b, {ENTRY_BODY} AS c FROM documents)"
QUESTIONS_SQL = f"(SELECT item_id AS a, {QUESTION} AS b FROM benchmark)"


def _entries(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(ENTRY_TITLE).alias("title"), F.expr(ENTRY_BODY).alias("body"))


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.expr(QUESTION).alias("q"))


ENTITY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(h, '{'|'.join(w)}') THEN '{k}'" for k, w in C.ENTITY_WORDS) + " ELSE 'other' END"


@query(f"SELECT CAST(a AS BIGINT) AS id, {ENTITY_SQL} AS kind FROM (SELECT a, b || chr(10) || substr(c, 1, 80) AS h FROM {ENTRIES_SQL})")
def x11_entity_type(spark, d):
    return _entries(spark, d).select("id", annotate.entity_type(F.col("title"), F.col("body")).alias("kind"))


_TAIL = "regexp_extract(b, '([A-Za-z \\t\\n\\f\\r''-]+)$', 1)"


@query(f"""
WITH v0 AS (SELECT * FROM {ENTRIES_SQL}),
m AS (SELECT a, unnest(regexp_extract_all(b || chr(10) || c, '(?:又名|别名|亦称)[:：]{SPACES}*([^\\n]+)', 1)) AS x FROM v0),
p AS (
  SELECT a, unnest(regexp_split_to_array(x, '[、,/，;；]')) AS x FROM m
  UNION ALL SELECT a, regexp_extract(b, '(.+?)[（(]([^）)]+)[）)]', 2) FROM v0 WHERE length(trim(regexp_extract(b, '(.+?)[（(]([^）)]+)[）)]', 2))) <= 20
  UNION ALL SELECT a, {_TAIL} FROM v0 WHERE length({_STRIP(_TAIL)}) >= 2 AND regexp_matches(replace(b, {_TAIL}, ''), '[一-鿿㐀-䶿]')
), q AS (SELECT DISTINCT a, {_STRIP('x')} AS x FROM p WHERE {_STRIP('x')} <> '')
SELECT CAST(v0.a AS BIGINT) AS id, coalesce(string_agg(x, ',' ORDER BY encode(x)), '') AS names FROM v0 LEFT JOIN q USING (a) GROUP BY v0.a
""")
def x12_aliases(spark, d):
    return _entries(spark, d).select("id", F.array_join(annotate.aliases(F.col("title"), F.col("body")), ",").alias("names"))


_LINES_SQL = "string_split(c, chr(10))"


@query(f"""
SELECT CAST(a AS BIGINT) AS id, CAST(1
  | CASE WHEN len(list_filter({_LINES_SQL}, lambda x: starts_with(trim(x), '【秘密】') OR starts_with(trim(x), '【密谋】') OR contains(lower(x), 'secret'))) > 0 THEN 4 ELSE 0 END
  | CASE WHEN len(list_filter({_LINES_SQL}, lambda x: starts_with(trim(x), '【DM】') OR starts_with(trim(x), 'DM only') OR contains(x, '对玩家隐藏'))) > 0 THEN 2 ELSE 0 END AS BIGINT) AS vis
FROM {ENTRIES_SQL}
""")
def x15_visibility(spark, d):
    return _entries(spark, d).select("id", annotate.visibility(F.col("body")).alias("vis"))


_SECRET = "(starts_with(trim(x), '【秘密】') OR starts_with(trim(x), '【DM】') OR starts_with(trim(x), '【密谋】') OR contains(x, '对玩家隐藏'))"


@query(f"""
SELECT CAST(a AS BIGINT) AS id, CASE WHEN trim(s) <> '' THEN s WHEN len(list_filter({_LINES_SQL}, lambda x: {_SECRET})) > 0 THEN '（该条目对玩家隐藏）' ELSE c END AS body
FROM (SELECT a, c, array_to_string(list_filter({_LINES_SQL}, lambda x: NOT {_SECRET}), chr(10)) AS s FROM {ENTRIES_SQL})
""")
def x16_public_body(spark, d):
    return _entries(spark, d).select("id", annotate.public_body(F.col("body"), F.lit(C.PUBLIC).cast("long")).alias("body"))


@query(f"""
SELECT CAST(a AS BIGINT) AS id, b || CASE WHEN c <> '' THEN chr(10) || c ELSE '' END || CASE WHEN c <> '' THEN chr(10) || {_N('c')} ELSE '' END AS search_text FROM {ENTRIES_SQL}
""")
def x14_search_text(spark, d):
    none = F.array().cast("array<string>")
    return _entries(spark, d).select("id", annotate.search_text(F.col("title"), F.col("body"), none, F.lit("")).alias("search_text"))


# Begins of texts as lines, with the marks that tell titles from sentences.
LINE = f"""CASE doc_id % 9 WHEN 0 THEN '第' || doc_id || '章 ' || source WHEN 1 THEN '【' || lang || '】' WHEN 2 THEN lang || '：' || source WHEN 3 THEN {_HANZI_OF.format('substr(text, 1, 12)')}
  WHEN 4 THEN substr(text, 1, 15) || '。' WHEN 5 THEN substr(text, 1, 10) || '；' WHEN 6 THEN substr(text, 1, 1) WHEN 7 THEN text ELSE trim(substr(text, 1, 16)) || ' 回' END"""


@query(f"""
SELECT doc_id, length(x) BETWEEN 2 AND 16 AND NOT (starts_with(x, '第') OR regexp_matches(x, '[章节回]'))
  AND ((starts_with(x, '【') AND ends_with(x, '】')) OR (NOT regexp_matches(x, '[；;]$') AND NOT regexp_matches(x, '[。！？：:]'))) AS heading,
  starts_with(x, '第') OR regexp_matches(x, '[章节回]') AS chapter FROM (SELECT doc_id, {_STRIP('b')} AS x FROM (SELECT doc_id, {LINE} AS b FROM documents))
""")
def f7_entry_heading(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(LINE).alias("line"))
    return t.select("doc_id", annotate.entry_heading(F.col("line")).alias("heading"), annotate.chapter_like(F.col("line")).alias("chapter"))


@query("SELECT doc_id, length(text) >= 800 AND (regexp_matches(source, '1') AND false OR length(text) >= 2200) AS wants FROM documents")
def f9_wants_model(spark, d):
    return table(spark, d, "documents").select("doc_id", annotate.wants_model(F.col("source"), F.col("text")).alias("wants"))


@query(f"SELECT CAST(a AS BIGINT) AS id, array_to_string(list_transform(regexp_extract_all(b, '[一-鿿㐀-䶿]+|[A-Za-z0-9]+'), lambda x: lower(x)), ',') AS runs FROM {QUESTIONS_SQL}")
def x21_runs(spark, d):
    return _questions(spark, d).select("id", F.array_join(T.runs(F.col("q")), ",").alias("runs"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted({w for w in C.STOP_WORDS if len(w) == 1})) + "]"


@query(f"""
WITH r AS (SELECT a, b, unnest([4, 3]) AS n, unnest([0, 1]) AS o FROM {QUESTIONS_SQL}),
g AS (SELECT a, o, unnest(range(1, greatest(length(b) - n + 2, 1))) AS i, b, n FROM r),
h AS (SELECT a, o, i, substr(b, i, n) AS g FROM g WHERE NOT list_contains({_STOPS}, substr(b, i, 1)) AND NOT list_contains({_STOPS}, substr(b, i + n - 1, 1)))
SELECT CAST(v.a AS BIGINT) AS id, coalesce((SELECT string_agg(g, '|' ORDER BY o, i) FROM h WHERE h.a = v.a), '') AS grams FROM {QUESTIONS_SQL} v
""")
def x22_ngrams(spark, d):
    return _questions(spark, d).select("id", F.array_join(T.ngrams(F.col("q")), "|").alias("grams"))


@query(f"WITH {TERMS_SQL} SELECT item_id, rank, t AS term FROM k WHERE rank <= 48")
def x20_query_terms(spark, d):
    q = searching.prepare(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    t = q.select(F.col("qid").alias("item_id"), F.posexplode(T.extract_udf({})("q")).alias("i", "term"))
    return t.select("item_id", (F.col("i") + 1).cast("long").alias("rank"), "term")


TERM = """CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN p_name WHEN 2 THEN 'say "' || p_name || '" "x' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'and' ELSE 'Near' END ELSE '独眼' || p_name END"""


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(t, '^[A-Za-z0-9]+$') AND upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR', 'MATCH') THEN t ELSE '"' || replace(t, '"', '""') || '"' END AS escaped,
  CASE WHEN contains(t, '"') THEN 'x' ELSE t END AS back FROM (SELECT p_partkey, {TERM} AS t FROM part)
""")
def q5_escape_terms(spark, d):
    e = T.escape(F.col("term"))
    t = table(spark, d, "part").select("p_partkey", F.expr(TERM).alias("term"))
    return t.select("p_partkey", e.alias("escaped"), F.when(F.col("term").contains('"'), F.lit("x")).otherwise(T.unescape(e)).alias("back"))


@query("""
WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), s AS (SELECT * FROM (VALUES ('red', 'crimson'), ('blue', 'azure'), ('crimson', 'ruby')) v(term, canonical))
SELECT p_partkey AS qid, term FROM p UNION SELECT p_partkey, canonical FROM p JOIN s USING (term)
""")
def j5_synonyms(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.explode(F.split("p_name", " ")).alias("term"))
    s = literal(spark, [("red", "crimson"), ("blue", "azure"), ("crimson", "ruby")], "term string, canonical string")
    return maintain.expand_synonyms(t, s)


@query("""
WITH g AS (SELECT item_id, regexp_replace(text, '\\s', '', 'g') AS t FROM benchmark),
b AS (SELECT item_id, substr(t, i, 2) AS g, count(*) AS c FROM (SELECT item_id, t, unnest(range(1, length(t))) AS i FROM g) GROUP BY ALL),
n AS (SELECT item_id, sum(c) AS n FROM b GROUP BY item_id),
s AS (SELECT x.item_id AS a, y.item_id AS b, sum(least(x.c, y.c)) AS k FROM b x JOIN b y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL)
SELECT s.a, s.b, round(2.0::DOUBLE * k / (x.n + y.n), 9) AS dice FROM s JOIN n x ON x.item_id = s.a JOIN n y ON y.item_id = s.b WHERE 2.0::DOUBLE * k / (x.n + y.n) >= 0.5
""".replace("\\\\s", "\\s"))
def x29_dice(spark, d):
    """All pairs of benchmark texts that are half alike or more."""
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.alike_pairs(t, 0.5).select("a", "b", F.round("sim", 9).alias("dice"))


@query("""
WITH p AS (SELECT a.p_partkey AS id, replace(a.p_name, ' ', '') AS x, replace(b.p_name, ' ', '') AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
g AS (SELECT id, 0 AS side, substr(x, i, 2) AS g FROM (SELECT id, x, unnest(range(1, length(x))) AS i FROM p) UNION ALL SELECT id, 1, substr(y, i, 2) FROM (SELECT id, y, unnest(range(1, length(y))) AS i FROM p)),
c AS (SELECT id, g, count(*) FILTER (side = 0) AS m, count(*) FILTER (side = 1) AS n FROM g GROUP BY id, g)
SELECT id, round(2.0::DOUBLE * sum(least(m, n)) / sum(m + n), 9) AS dice FROM c GROUP BY id
""")
def j13_dice_pairs(spark, d):
    """Each name with the next one."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    return both.select(F.col("p_partkey").alias("id"), F.round(similarity.dice(F.col("p_name"), F.col("next")), 9).alias("dice"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, 90) || CASE WHEN s + 90 < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT doc_id, text, CAST(greatest(instr(text, 'ion ') - 81, 0) AS BIGINT) AS s FROM (SELECT doc_id, text FROM documents))
""".replace("'ion '", "'tion'"))
def x33_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(" tion ")).alias("snippet"))


@query("""
SELECT doc_id, coalesce(string_agg((a - 1) || '-' || (a + 3), ',' ORDER BY a), '') AS spans FROM documents LEFT JOIN (
  SELECT doc_id AS id, sum(length(x) + 4) OVER (PARTITION BY doc_id ORDER BY i) - 3 AS a, i < n - 1 AS inner_ FROM (
    SELECT doc_id, unnest(string_split(text, 'tion')) AS x, unnest(range(len(string_split(text, 'tion')))) AS i, len(string_split(text, 'tion')) AS n FROM documents)
) ON id = doc_id AND inner_ GROUP BY doc_id
""")
def x34_highlight(spark, d):
    spans = F.transform(text.highlight(F.col("text"), F.lit(" tion ")), lambda x: F.concat_ws("-", x["start"], x["end"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(spans, ",").alias("spans"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'an', ''))) // 2 AS n FROM documents")
def a9_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("an")).alias("n"))


_PAY = "'other　' || source || chr(10) || text || chr(10) || '—— ' || lang || ' · ' || source"


@query(f"SELECT doc_id, sha256({_PAY}) AS player, sha256(source || chr(10) || text || chr(10) || '来源：' || lang || ' · ' || source) AS full_, lang || ' · ' || source AS origin FROM documents")
def x30_copy_template(spark, d):
    row = {"entity_type": F.lit("other"), "title": F.col("source"), "body": F.col("text"), "public_body": annotate.public_body(F.col("text"), F.lit(1).cast("long")), "source_path": F.concat_ws(" · ", "lang", "source")}
    fill = lambda key: text.copy_payload(text.template_of(F.lit(key), F.lit(None).cast("string")), row)
    return table(spark, d, "documents").select("doc_id", F.sha2(fill("player"), 256).alias("player"), F.sha2(fill("full"), 256).alias("full_"), fill("source").alias("origin"))


@query("""
SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped,
  sha256(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')) AS decoded, true AS back FROM pages
""")
def x36_xml_entities(spark, d):
    t, back = table(spark, d, "pages"), text.decode_entities(text.xml_escape(F.col("html")))
    # Decoding undoes escaping, unless what was escaped looks like an entity itself.
    same = (back == F.col("html")) | F.col("html").contains("&")
    return t.select("page_id", F.sha2(text.xml_escape(F.col("html")), 256).alias("escaped"), F.sha2(text.decode_entities(F.col("html")), 256).alias("decoded"), same.alias("back"))


HEADING_PATH = "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || ' / ' || lang ELSE lang || ' / ' || text || ' / ' || source END"


@query(f"SELECT doc_id, sha1(CASE WHEN contains(p, ' / ') THEN array_to_string(string_split(p, ' / ')[:-2], ' / ') ELSE '' END) AS prefix FROM (SELECT doc_id, {HEADING_PATH} AS p FROM documents)")
def x32_chapter_prefix(spark, d):
    p = annotate.chapter_prefix(F.expr(HEADING_PATH))
    return table(spark, d, "documents").select("doc_id", F.sha1(p.cast("binary")).alias("prefix"))


# ---------------------------------------------------------------- upkeep

_FILES = "SELECT 'in/' || (CASE WHEN doc_id % 11 = 0 THEN 'moved/' ELSE '' END) || doc_id || '.txt' AS rel_path, sha256(text || CASE WHEN doc_id % 5 = 0 THEN ' more' ELSE '' END) AS content_hash FROM documents"
_KNOWN = "SELECT doc_id, 'in/' || doc_id || '.txt' AS file_path, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 <> 0"


@query(f"""
WITH f AS ({_FILES}), k AS ({_KNOWN}), alone AS (SELECT content_hash, min(doc_id) AS doc_id FROM k GROUP BY content_hash HAVING count(*) = 1)
SELECT f.rel_path, CASE WHEN k.doc_id IS NOT NULL THEN CASE WHEN k.content_hash = f.content_hash THEN 'skip' ELSE 'changed' END WHEN a.doc_id IS NOT NULL THEN 'moved' ELSE 'new' END AS status,
  coalesce(k.doc_id, a.doc_id) AS doc_id FROM f LEFT JOIN k ON k.file_path = f.rel_path LEFT JOIN alone a ON k.doc_id IS NULL AND a.content_hash = f.content_hash
""")
def i1_change_detect(spark, d):
    t = table(spark, d, "documents")
    name = F.concat(F.lit("in/"), F.when(F.col("doc_id") % 11 == 0, F.lit("moved/")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" more")).otherwise(F.lit("")))
    found = t.select(name.alias("rel_path"), F.sha2(body, 256).alias("content_hash"))
    known = t.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    return maintain.detect(found, known).select("rel_path", "status", "doc_id")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey + 100000000, 'N', 0.0 FROM orders WHERE o_orderkey % 70 = 0
""")
def k3_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = new.unionByName(o.where("o_orderkey % 70 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")))
    return maintain.upsert(o, new, ["o_orderkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)
UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_custkey % 10 = 0
""")
def k4_replace_children(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    changed = table(spark, d, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = changed.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return maintain.replace_children(old, new, changed, "l_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def k7_last_write(spark, d):
    o = table(spark, d, "orders")
    return maintain.last_write(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def k10_retention(spark, d):
    return maintain.retain(table(spark, d, "events"), "user_id", 50, F.desc("event_id")).select("event_id", "user_id")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def j9_neighbours(spark, d):
    return maintain.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "turn").select("conv_id", "turn", "prev_id", "next_id")


_DRAFTS = "SELECT doc_id % 10 AS doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) - 1 AS ordinal, sha1(source) AS stable_key, sha1(lang || (doc_id % 4)) AS alt_anchor FROM documents"
_CORR = "SELECT d.doc_id AS correction_id, d.doc_id % 10 AS doc_id, CASE WHEN quality = 1 THEN sha1(source) ELSE 'none' END AS stable_key, CASE WHEN toxic = 1 THEN NULL ELSE sha1(lang || (d.doc_id % 4)) END AS alt_anchor FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@query(f"""
WITH d AS ({_DRAFTS}), c AS ({_CORR}),
d1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stable_key ORDER BY ordinal) AS k FROM d), c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stable_key ORDER BY correction_id) AS k FROM c),
p AS (SELECT d1.doc_id, ordinal, correction_id FROM d1 JOIN c1 USING (doc_id, stable_key, k)),
d2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, alt_anchor ORDER BY ordinal) AS k FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND p.ordinal = d.ordinal)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, alt_anchor ORDER BY correction_id) AS k FROM c WHERE alt_anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.correction_id = c.correction_id))
SELECT doc_id, ordinal, correction_id FROM p UNION ALL SELECT d2.doc_id, ordinal, correction_id FROM d2 JOIN c2 USING (doc_id, alt_anchor, k)
""")
def i4_corrections(spark, d):
    t = table(spark, d, "documents")
    mod = (F.col("doc_id") % 10).alias("doc_id")
    anchor = F.sha1(F.concat("lang", (F.col("doc_id") % 4).cast("string")).cast("binary"))
    key = F.sha1(F.col("source").cast("binary"))
    drafts = t.select(mod, (F.row_number().over(W.partitionBy(F.col("doc_id") % 10).orderBy("doc_id")) - 1).cast("long").alias("ordinal"), key.alias("stable_key"), anchor.alias("alt_anchor"))
    c = t.join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("correction_id"), mod, F.when(F.col("quality") == 1, key).otherwise(F.lit("none")).alias("stable_key"), F.when(F.col("toxic") == 1, F.lit(None)).otherwise(anchor).alias("alt_anchor"))
    return maintain.match_corrections(drafts, c)


@query("""
WITH b AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY ts, event_id) AS ids FROM r GROUP BY user_id, run
""")
def a13_coalesce_runs(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").alias("ids"))
    return maintain.coalesce_runs(e, "user_id", ["ts", "event_id"], "event_type", "ids")


@query("""
SELECT count_if(q = 1 AND t = 0) AS files_ok, count_if(q = 0 AND t = 0) AS files_skip, count_if(t = 1) AS files_fail, CAST(coalesce(sum(quality), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS unmatched_corrections
FROM (SELECT *, quality AS q, toxic AS t FROM labels)
""")
def a11_import_report(spark, d):
    s = table(spark, d, "labels").select(
        F.lit("doc").alias("class"), F.when(F.col("quality") == 0, F.lit("skip")).otherwise(F.lit("new")).alias("status"), F.when(F.col("toxic") == 1, F.lit("bad")).alias("error"),
        F.lit(None).cast("string").alias("message"), F.lit("p").alias("path"), F.col("quality").alias("chunks"), F.col("toxic").alias("unmatched"), F.lit(None).cast("string").alias("warning"))
    return maintain.import_report(s).drop("errors", "warnings")


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT min(doc_id) FROM documents) AS first_doc, true AS semantic_ready, 3 AS schema_version")
def a1_store_info(spark, d):
    return maintain.info(table(spark, d, "documents"), table(spark, d, "region"), table(spark, d, "embeddings"))


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS id FROM orders
""")
def k4_new_ids(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return maintain.number(o, 100, ["o_orderdate", "o_orderkey"], Scratch(spark, "ids")).select("o_orderkey", "id")


@query("SELECT doc_id, CAST(CASE WHEN toxic = 1 THEN 5 ELSE 1 END AS BIGINT) AS visibility, toxic = 1 AS hidden, toxic = 1 AS secret FROM labels")
def f14_visibility_bits(spark, d):
    v = F.when(F.col("toxic") == 1, F.lit(C.PUBLIC | C.SECRET)).otherwise(F.lit(C.PUBLIC)).cast("long")
    return table(spark, d, "labels").select("doc_id", v.alias("visibility"), annotate.is_hidden(v).alias("hidden"), annotate.is_secret(v).alias("secret"))


# ---------------------------------------------------------------- more of the inventory


@query("SELECT o_orderkey AS id, o_custkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def j1_load_rows(spark, d):
    """Ids first, the rest of the columns only for them."""
    hits = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), "o_custkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    return rows.join(hits, "id").select("id", "o_custkey", "l_linenumber", "l_quantity")


@query("""
WITH g AS (SELECT p_partkey, p_brand || p_size AS p_size, p_name, unnest(range(1, length(replace(p_name, ' ', '')))) AS i, replace(p_name, ' ', '') AS t FROM part),
b AS (SELECT p_partkey, p_size, substr(t, i, 2) AS g, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT p_partkey, sum(c) AS n FROM b GROUP BY p_partkey),
s AS (SELECT x.p_partkey AS nid, y.p_partkey AS idx, sum(least(x.c, y.c)) AS k FROM b x JOIN b y ON x.p_size = y.p_size AND x.g = y.g WHERE y.p_partkey <> x.p_partkey GROUP BY ALL),
d AS (SELECT nid, idx, 2.0 * k / (x.n + y.n) AS sim FROM s JOIN n x ON x.p_partkey = nid JOIN n y ON y.p_partkey = idx)
SELECT nid, idx, round(sim, 9) AS sim FROM d WHERE sim >= 0.7 QUALIFY row_number() OVER (PARTITION BY nid ORDER BY sim DESC, idx) = 1
""")
def j13_best_segment(spark, d):
    p = table(spark, d, "part").withColumn("p_size", F.concat("p_brand", F.col("p_size").cast("string")))
    needles = p.select("p_size", F.col("p_partkey").alias("nid"), F.col("p_name").alias("needle"), F.lit(-1).alias("from"))
    segs = p.select("p_size", F.col("p_partkey").alias("idx"), F.lit(0).alias("offset"), F.col("p_name").alias("text"))
    got = similarity.best_segment(needles, segs, "p_size", apart=True)
    return got.select("nid", "idx", F.round("sim", 9).alias("sim"))


@query("SELECT round(min(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS worst FROM embeddings")
def a18_worst_cosine(spark, d):
    return table(spark, d, "embeddings").agg(F.round(F.min(vectors.dot(F.col("embedding"), vectors.l2_normalize(F.col("embedding")))), 6).alias("worst"))


@query(f"""
WITH d AS ({_DRAFTS}), c AS ({_CORR}),
d1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stable_key ORDER BY ordinal) AS k FROM d), c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stable_key ORDER BY correction_id) AS k FROM c),
p AS (SELECT d1.doc_id, ordinal, correction_id FROM d1 JOIN c1 USING (doc_id, stable_key, k)),
d2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, alt_anchor ORDER BY ordinal) AS k FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND p.ordinal = d.ordinal)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, alt_anchor ORDER BY correction_id) AS k FROM c WHERE alt_anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.correction_id = c.correction_id))
SELECT (SELECT count(*) FROM c) - (SELECT count(*) FROM p) - (SELECT count(*) FROM d2 JOIN c2 USING (doc_id, alt_anchor, k)) AS unmatched
""")
def a12_unmatched_corrections(spark, d):
    pairs = i4_corrections(spark, d)
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("correction_id"))
    return c.join(pairs, "correction_id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


@query("SELECT min(o_orderkey) AS first_id FROM orders")
def w8_first_id(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderkey").alias("first_id"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations WHERE turn % 3 <> 1")
def w12_renumber(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").where("turn % 3 <> 1").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS short, CASE WHEN instr(substr(text, 101), 'th') > 0 THEN (instr(substr(text, 101), 'th') + 99)::BIGINT ELSE -1 END AS at FROM documents
""")
def x35_truncate_and_find(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.truncate(t, 60).alias("short"), text.find_in(t, F.lit("th"), F.lit(100)).cast("long").alias("at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def x37_timestamps(spark, d):
    from lorevane.session import configure

    configure(spark)
    return table(spark, d, "events").select("event_id", text.timestamp_text(F.col("ts")).alias("at"))


@query(f"""
SELECT CAST(a AS BIGINT) AS id, regexp_matches(b, '[一-鿿㐀-䶿]{{7,}}') AS long_run, regexp_matches(b, '[一-鿿㐀-䶿]') AS hanzi, regexp_matches(b, '^[A-Za-z0-9]+$') AS latin FROM {QUESTIONS_SQL}
""")
def f10_script_tests(spark, d):
    q = F.col("q")
    return _questions(spark, d).select("id", text.has_long_run(q).alias("long_run"), text.has_hanzi(q).alias("hanzi"), text.is_latin_or_digit(q).alias("latin"))


@query(f"WITH {LANES_SQL} SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM top GROUP BY qid HAVING count(DISTINCT id) >= 3)")
def q6_gate(spark, d):
    """The queries whose lanes found fewer than three chunks."""
    return searching.gate(table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), _lanes(spark, d))


@query()
def q7_spellings(spark, d):
    """Romanised forms of names, by the readings that come with Spark."""
    from lorevane.functions import han

    bag = T.pinyin_bag(han.readings(spark))
    return _entries(spark, d).select("id", bag(F.col("title"), annotate.aliases(F.col("title"), F.col("body"))).alias("bag"))


# Pairs of traditional and simplified characters that no rule disagrees about.
TRADITIONAL, SIMPLIFIED = "斷橋獨門鐵龍馬鳥魚車東風", "断桥独门铁龙马鸟鱼车东风"


@query(f"SELECT p_partkey, translate(p_name, 'abcdefghijkl', '{SIMPLIFIED}') AS simple FROM part")
def x2_simplified(spark, d):
    from lorevane.functions import han

    raw = F.translate("p_name", "abcdefghijkl", TRADITIONAL)
    return table(spark, d, "part").select("p_partkey", text.to_simplified(raw, han.simplified(spark)).alias("simple"))


STYLE = "CASE doc_id % 5 WHEN 0 THEN 'Heading' WHEN 1 THEN 'heading ' WHEN 2 THEN '标题' WHEN 3 THEN '標題 0' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN source ELSE CAST(doc_id % 7 AS VARCHAR(3)) END"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 BETWEEN 1 AND 4 THEN doc_id % 7 END AS level FROM documents
""")
def s10_style_level(spark, d):
    """No source of a document is a number or a style."""
    return table(spark, d, "documents").select("doc_id", docx.level_of_style(F.expr(STYLE)).cast("long").alias("level"))


@query(f"""
SELECT doc_id, CASE WHEN length(x) NOT BETWEEN 1 AND 32 OR contains(x, '<') THEN NULL WHEN starts_with(x, '第') AND regexp_matches(x, '[章节回]') THEN 1
  WHEN length(x) BETWEEN 2 AND 12 AND NOT regexp_matches(x, '^[^：]+：(?s:.{{2,}})$') AND NOT (NOT contains(x, '：') AND regexp_matches(x, '^[^:]+:(?s:.{{2,}})$')) AND NOT regexp_matches(x, '[；;]$|[。！？]') THEN 2 END::BIGINT AS level
FROM (SELECT doc_id, {_STRIP('b')} AS x FROM (SELECT doc_id, {LINE} AS b FROM documents))
""")
def s11_text_level(spark, d):
    return table(spark, d, "documents").select("doc_id", docx.level_of_text(F.expr(LINE)).cast("long").alias("level"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
h AS (
  SELECT doc_id, i, {_STRIP('x')} AS x, length({_STRIP('x')}) BETWEEN 2 AND 16 AND NOT regexp_matches({_STRIP('x')}, '^第|[章节回]') AND ((starts_with({_STRIP('x')}, '【') AND ends_with({_STRIP('x')}, '】')) OR (NOT regexp_matches({_STRIP('x')}, '[；;]$') AND NOT regexp_matches({_STRIP('x')}, '[。！？：:]'))) AS head FROM l
), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h),
b AS (SELECT doc_id, grp, max(CASE WHEN head THEN {_STRIP("regexp_replace(x, '^[【】「」\\[\\]]+|[【】「」\\[\\]]+$', '', 'g')")} END) AS title, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT head AND x <> ''), '') AS body FROM g GROUP BY doc_id, grp)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS i, coalesce(nullif(title, ''), '未命名块') AS title, sha1(body) AS sha FROM b
WHERE (coalesce(title, '') <> '' AND length(body) >= 12) OR (coalesce(title, '') = '' AND length(body) >= 40)
""")
def i6_local_split(spark, d):
    t = _cut(spark, d, refine.local_split(F.col("text")))
    return t.select("doc_id", "i", F.col("part.title").alias("title"), F.sha1(F.col("part.body").cast("binary")).alias("sha"))


@query(f"""
WITH RECURSIVE {_SEGMENTS_SQL}, cut AS (SELECT s.doc_id, s.i, s.a, t.text FROM segs s JOIN documents t USING (doc_id) WHERE s.i IN (0, 3, 6, 9)),
c(doc_id, i, kept, pos, text) AS (
  SELECT doc_id, i, i, a, text FROM cut WHERE i = 0
  UNION ALL SELECT c.doc_id, n.i, CASE WHEN near THEN c.kept ELSE n.i END, CASE WHEN near THEN c.pos ELSE n.a END, c.text
  FROM c JOIN cut n ON n.doc_id = c.doc_id AND n.i = c.i + 3, LATERAL (SELECT strlen(substr(c.text, c.pos + 1, n.a - c.pos)) < 24 AS near)
), e AS (SELECT DISTINCT doc_id, kept, pos, text FROM c),
b AS (SELECT doc_id, kept, pos, {_STRIP('substr(text, pos + 1, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) - pos)')} AS body FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, 'part ' || kept AS title, sha1(body) AS sha FROM b WHERE length(body) >= 8
""")
def i7_materialize(spark, d):
    """Cuts proposed by segment number, taken back to the source."""
    t = table(spark, d, "documents")
    e = F.array(*[F.struct(F.lit(f"part {n}").alias("title"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("entity_type"), F.lit("").alias("body"), F.lit("").alias("anchor"), F.lit(n).cast("long").alias("start")) for n in range(0, 12, 3)])
    got = t.select("doc_id", F.posexplode(refine.materialize_udf("text", e)).alias("i", "e"))
    return got.select("doc_id", F.col("i").cast("long").alias("i"), F.col("e.title").alias("title"), F.sha1(F.col("e.body").cast("binary")).alias("sha"))


@query("SELECT doc_id, source || CASE WHEN lang <> source THEN ',' || lang ELSE '' END || ',' || doc_id AS names FROM documents")
def o3_name_union(spark, d):
    """Names in the order in which they first come, each once."""
    u = F.array_union(F.array("source", "lang"), F.array("lang", F.col("doc_id").cast("string"), "source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(u, ",").alias("names"))


@query(f"""
WITH RECURSIVE {_windows_sql('SELECT doc_id AS key, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)')} SELECT key AS chunk_id, i AS seq, 1.0::DOUBLE AS norm FROM windows
""")
def i12_backfill(spark, d):
    """Windows of the documents without vectors, encoded by the stand-in."""
    from lorevane.plans import importing

    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    got, _ = importing.backfill(chunks, have, importing.hashed_encoder())
    return got.select("chunk_id", F.col("seq").cast("long").alias("seq"), F.round(vectors.dot(F.col("v"), F.col("v")), 3).alias("norm"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def r2_stream_retention(spark, d):
    """The events as a stream into a bounded log; what the log holds at the end."""
    from lorevane.streaming.incremental import keep_latest

    scratch = Scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque*").select("event_id", "user_id")
    keep_latest(rows, "user_id", ["event_id"], f"{scratch.base}/log", f"{scratch.base}/cp", keep=50).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{scratch.base}/log/v0")
