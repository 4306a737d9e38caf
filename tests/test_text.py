import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevane.functions import annotate, han, text
from lorevane.functions import terms as T
from lorevane.operators import fulltext, refine
from lorevane.operators.similarity import dice


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_simplified_and_readings(spark):
    table = han.simplified(spark)
    assert one(spark, text.normalize(F.lit("獨眼　酒館  ＡＢ"), table)) == "独眼 酒馆 AB"
    r = han.readings(spark)
    assert {"gelimu", "glm", "ge li mu"} <= set(T.spellings("格里姆", r))
    assert len(T.spellings("行长重乐了", r)) <= 3 * 16
    assert T.spellings("abc", r) == []


def test_terms(spark):
    r = han.readings(spark)
    got = T.extract("我们之前在那个独眼酒保的店里拿到了货", r)
    assert "独眼酒保" in got and len(got) <= 48 and all(len(t) >= 3 for t in got)
    assert T.extract("老格", r)[0] in T.spellings("老格", r)
    assert T.extract("", r) == [] and "abc" in T.extract("ABC", {})
    assert one(spark, T.escape(F.lit("and"))) == '"and"'


def test_known_hashes(spark):
    assert one(spark, annotate.file_hash(F.lit("abc").cast("binary"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, annotate.stable_key(F.lit("a"), F.lit("b"))) != one(spark, annotate.stable_key(F.lit("a"), F.lit("b"), ordinal=F.lit(1)))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aA　Ｂ獨 \t\n é", max_size=12), min_size=1, max_size=20))
def test_normalize_twice_is_once(spark, rows):
    d = spark.createDataFrame([(x,) for x in rows], "t string").select(text.normalize(F.col("t"), ("獨", "独")).alias("n"))
    assert all(a == b for a, b in d.select("n", text.normalize(F.col("n"), ("獨", "独"))).collect())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab 铁匕首", max_size=8), st.text("ab 铁匕首", max_size=8)), min_size=1, max_size=20))
def test_dice(spark, pairs):
    d = spark.createDataFrame(pairs, "a string, b string").select(dice(F.col("a"), F.col("b")).alias("x"), dice(F.col("b"), F.col("a")).alias("y")).collect()
    for (a, b), r in zip(pairs, d):
        assert abs(r.x - r.y) < 1e-12 and abs(r.x - refine.dice(a, b)) < 1e-12 and 0 <= r.x <= 1


def test_public_body(spark):
    body = "公开。\n【秘密】藏在井下\n【DM】别说\n结尾"
    assert one(spark, annotate.public_body(F.lit(body), F.lit(7).cast("long"))) == "公开。\n结尾"
    assert one(spark, annotate.public_body(F.lit("【秘密】x"), F.lit(1).cast("long"))) == "（该条目对玩家隐藏）"
    assert one(spark, annotate.public_body(F.lit("x"), F.lit(8).cast("long"))) == "x"


def test_bm25_against_sqlite(spark):
    rows = [(1, "铁门", "铁门在山口，铁门很重 iron gate"), (2, "灰港", "港口 harbour gate"), (3, "酒馆", "独眼酒保的酒馆"), (4, "x", "anananan banana"), (5, "É", "été gate été")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body, tokenize='trigram')")
    db.executemany("insert into f(rowid, title, body) values (?,?,?)", rows)
    phrases = ["gate", "铁门在", "独眼酒", "ana", "ÉTÉ", "ga"]
    want = dict(db.execute("select rowid, -bm25(f) from f where f match ?", (" OR ".join(f'"{p}"' for p in phrases),)).fetchall())
    chunks = spark.createDataFrame(rows, "id long, title string, search_text string")
    q = spark.createDataFrame([(1, p) for p in phrases], "qid int, phrase string")
    for postings in (None, fulltext.index(chunks)):
        got = {r.id: r.score for r in fulltext.match(q, chunks, postings=postings).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rank_of_short_and_long_forms(spark):
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.strip_code_fence(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, text.strip_heading_marks(F.lit("【「铁门」】"))) == "铁门"
    assert one(spark, text.find_in(F.lit("abcabc"), F.lit("bc"), F.lit(2))) == 4
    assert one(spark, text.timestamp_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"


def plain_search(chunks, queries):
    """The read path for Latin queries in plain Python."""
    import math

    out = {}
    sizes = {i: max(len(t) - 2, 0) + max(len(s) - 2, 0) for i, _, t, _, s in chunks}
    n, avg = len(chunks), sum(sizes.values()) / len(chunks)
    count = lambda s, p: sum(s.startswith(p, i) for i in range(len(s)))
    for qid, text in queries:
        q, scores = " ".join(text.split()), {}
        for p in {t.lower() for t in T.extract(q, {})}:
            f = {i: c for i, _, t, _, s in chunks if (c := count(t.lower(), p) + count(s.lower(), p))}
            idf = math.log((n - len(f) + 0.5) / (len(f) + 0.5))
            for i, c in f.items():
                scores[i] = scores.get(i, 0) + (idf if idf > 0 else 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sizes[i] / avg))
        best = sorted(scores, key=lambda i: (-scores[i], i))[:30]
        rrf, hits, seen = {i: 1 / (61 + k) for k, i in enumerate(best)}, [], set()
        by = {c[0]: c for c in chunks}
        for i in best:
            _, doc, title, body, _ = by[i]
            if (doc, title) in seen:
                continue
            seen.add((doc, title))
            boost = 12 if title == q else 8 if q in title else 4 * body.count(q) / (1 + max(len(body), 1) / 160)
            hits.append((not (q in title), -(rrf[i] + boost), title, i))
        out[qid] = [(i, round(-s, 9)) for _, s, _, i in sorted(hits)[:20]]
    return out


def test_search_against_plain_version(spark):
    import random

    from lorevane.plans import searching

    rng, words = random.Random(1), "iron gate harbour mist tower ash bridge salt river anan the of".split()
    chunks = []
    for i in range(60):
        body = " ".join(rng.choices(words, k=rng.randint(3, 60)))
        title = " ".join(rng.choices(words, k=2))
        chunks.append((i, i % 20, title, body, f"{title}\n{body}"))
    queries = [(1, "iron gate"), (2, chunks[7][2]), (3, "anan  mist of the salt"), (4, "zzz"), (5, "ash"), (6, " ".join(chunks[3][3].split()[:9]))]
    c = spark.createDataFrame([(i, d, t, b, [], "p", 100, s) for i, d, t, b, s in chunks], "id long, doc_id long, title string, body string, names array<string>, parent_path string, source_rank int, search_text string")
    rows = searching.search(spark.createDataFrame(queries, "qid long, text string"), c).orderBy("qid", "rank").collect()
    got = {q: [(r.id, round(r.score, 9)) for r in rows if r.qid == q] for q, _ in queries}
    assert got == plain_search(chunks, queries) and got[4] == [] and got[2]


def test_best_segment_against_all_pairs(spark):
    import random
    from collections import Counter

    from lorevane.operators import similarity

    grams = lambda s: Counter(a + b for a, b in zip(s.replace(" ", ""), s.replace(" ", "")[1:]))

    def likeness(a, b):
        x, y = grams(a), grams(b)
        return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0

    rng = random.Random(4)
    name = lambda: " ".join(rng.choices(["iron", "gate", "gates", "aaaa", "aaa", "mist", "misty", "b"], k=rng.randint(1, 3)))
    needles = [(k, i, name(), rng.choice([-1, 5, 20])) for k in "xy" for i in range(40)]
    segments = [(k, i, rng.randint(0, 20), name()) for k in "xy" for i in range(60)]
    n = spark.createDataFrame(needles, "k string, nid long, needle string, from int")
    s = spark.createDataFrame(segments, "k string, idx long, offset int, text string")
    for apart in (False, True):
        want = {}
        for k, nid, needle, after in needles:
            may = [(-likeness(needle, t), i) for b, i, o, t in segments if b == k and o + len(t) > after and not (apart and i == nid)]
            if len(needle) >= 4 and may and -min(may)[0] >= 0.7:
                want[k, nid] = (min(may)[1], -min(may)[0])
        got = {(r.k, r.nid): (r.idx, r.sim) for r in similarity.best_segment(n, s, "k", apart=apart).collect()}
        assert got == want and len(want) > 20


def test_best_segment_of_many_copies(spark):
    """A block of copies is compared once: pair by pair these would be 2,500,000,000."""
    from lorevane.operators import similarity

    p = spark.range(50_000).select(F.lit("b").alias("k"), F.col("id").alias("nid"), F.lit("iron gate").alias("needle"), F.lit(-1).alias("from"))
    s = p.select("k", F.col("nid").alias("idx"), F.lit(0).alias("offset"), F.col("needle").alias("text"))
    got = similarity.best_segment(p, s, "k", apart=True)
    assert got.groupBy("idx").count().orderBy("idx").collect() == [(0, 49_999), (1, 1)]


def test_best_scan_against_all_matches(spark, monkeypatch):
    """The k best of tasks, with little held at a time, are those of all matches; no match leaves its task on its own."""
    import random

    from pyspark.sql import Window as W

    from lorevane.scratch import Scratch

    rng, words = random.Random(2), "iron gate harbour mist tower ash Ash bridge salt river anan banana the of".split()
    chunks = [(i if i < 150 else i + 900, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)]
    chunks += [(i + 1000, t, b) for i, t, b in chunks] + [(5000, "x", None)]
    c = spark.createDataFrame(chunks, "id long, title string, search_text string").repartition(3)
    queries = [(q, p) for q in range(8) for p in {*rng.choices(words, k=4), "zzzz", "ana", "of"}]
    q = spark.createDataFrame(queries, "qid int, phrase string")
    for only in (None, F.col("id") % 2 == 0):
        how = {"stats": fulltext.statistics(c), "only": only}
        want = fulltext.match(q, c, **how)
        rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
        first = lambda d: sorted(tuple(r) for r in d.withColumn("r", rank).where("r <= 9").select("qid", "r", "id", F.round("score", 6)).collect())  # noqa: E731,B023
        assert first(fulltext.best_scan(q, c, 9, scratch=Scratch(spark, "t"), **how)) == first(want) and first(want)
        rank = F.row_number().over(W.partitionBy("qid", "phrase").orderBy(F.desc(F.round("part", 9)), "id"))
        all_ = fulltext.parts(q, c, **how).withColumn("pos", rank - 1).where("pos < 9")
        each = fulltext.match_each(q, c, 9, scratch=Scratch(spark, "t"), **how)
        plain = fulltext.match_each(q, c, 9, **how)
        slim = lambda d: sorted(tuple(r) for r in d.select("qid", "phrase", "id", "pos", F.round("part", 6)).collect())
        assert slim(each) == slim(all_) == slim(plain)


def test_best_holds_little():
    import numpy as np

    rng = np.random.default_rng(1)
    best, rows, most = fulltext._Best(4, 5), [], 0
    for i in range(20):
        g, s = rng.integers(0, 4, 30_000), rng.integers(0, 500, 30_000) / 7
        ids = np.arange(i * 30_000, (i + 1) * 30_000)
        rows += zip(g, -np.round(s, 9), ids)
        best.add(g, ids, s)
        assert not best.full()
        most = max(most, best.n)
    got = sorted(zip(*(x.tolist() for x in best.take())), key=lambda r: (r[0], -r[2], r[1]))
    rows.sort()
    want = [r for g in range(4) for r in [x for x in rows if x[0] == g][:5]]
    assert [(g, i) for g, i, _ in got] == [(g, i) for g, _, i in want] and most < 300_000
