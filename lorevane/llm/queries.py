"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from . import chat, embed_dedup, line_dedup, lm, minhash, mixing, packing, pii, quality, topk
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of which documents go, by number."""
    return line_dedup.report(spark, table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces; their ids as a hash."""
    return packing.digest(packing.pack(spark, table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns; the rendered text as its hash."""
    t = table(spark, sf_dir, "conversations")
    out = chat.parse(spark, t.drop("role"), t)
    return out.select("conv_id", "chunk", "part", "first_turn", "opens", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_topk": op6_topk,
    "op7_minhash": op7_minhash,
    "op8_lm": op8_lm,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_mixing": op10_mixing,
}

SQL = {
    "op1_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, line, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\v\f]+', ' ', 'g')) AS c FROM raw
), f AS (SELECT * FROM l WHERE c <> ''),
d AS (SELECT c, min((doc_id, line)) AS at, length(c) AS n FROM f GROUP BY c),
p AS (
  SELECT a.c AS x, a.at AS ax, b.c AS y, b.at AS ay FROM d a JOIN d b
    ON left(a.c, CAST(floor(a.n / 2) AS BIGINT)) = left(b.c, CAST(floor(a.n / 2) AS BIGINT)) AND a.c <> b.c
    WHERE a.n >= 10 AND b.n >= 10 AND b.n BETWEEN a.n AND a.n + 1
  UNION
  SELECT a.c, a.at, b.c, b.at FROM d a JOIN d b
    ON right(a.c, CAST(floor(a.n / 2) AS BIGINT)) = right(b.c, CAST(floor(a.n / 2) AS BIGINT)) AND a.c <> b.c
    WHERE a.n >= 10 AND b.n >= 10 AND b.n BETWEEN a.n AND a.n + 1
), e AS (SELECT * FROM p WHERE levenshtein(x, y) <= 1),
near AS (SELECT x AS c FROM e WHERE ay < ax UNION SELECT y FROM e WHERE ax < ay),
w AS (
  SELECT f.doc_id, f.line, CASE WHEN near.c IS NOT NULL THEN 'near' WHEN (f.doc_id, f.line) > d.at THEN 'equal' END AS why
  FROM f JOIN d ON d.c = f.c LEFT JOIN near ON near.c = f.c
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (why = 'equal') AS n_equal, count(*) FILTER (why = 'near') AS n_near,
    string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (why IS NOT NULL) AS removed FROM w GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed
FROM documents t LEFT JOIN s ON s.doc_id = t.doc_id
""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * d.w[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.w) = len(d.w) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1), c AS (SELECT s.* FROM s JOIN m USING (s)),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.m = e.a),
g AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op9_embed_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w) AND list_cosine_similarity(a.w, b.w) >= 0.93
), c(id, m) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT c.id, e.b FROM c JOIN e ON c.m = e.a
), g AS (SELECT id, min(m) AS component_id FROM c GROUP BY id),
n AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT t.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, g.component_id, g.component_id = t.vec_id AS kept
FROM embeddings t JOIN g ON g.id = t.vec_id LEFT JOIN n ON n.a = t.vec_id
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, '')))) AS ord FROM documents
), z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM z),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM n),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS top FROM l WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT top FROM f) * w, cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS need FROM g),
r AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.need,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(need - ahead, 0)) AS BIGINT) AS taken FROM r
""",
}
