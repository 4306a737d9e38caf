import os

import edge
import pytest

import corpus_pipeline
from lorevane.llm import line_dedup, minhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mix", "pack"]
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns
        if i == 1:
            assert line_dedup.report(spark, out).selectExpr("sum(n_equal) + sum(n_near)").first()[0] == 0
        if i == 2:
            assert out.count() <= docs.count() and minhash.near_duplicates(spark, out, words=5, percent=80).where("not kept and n_shingles > 0").count() == 0
        seen.append(out.count())
        docs = out
    assert seen[1] < seen[0] and seen[3] <= seen[2] <= seen[1] < seen[5]
    assert corpus_pipeline.run(spark, SF).count() == seen[5]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, tmp_path, empty):
    """Nulls, empty and repeated rows and clashing columns go through all stages; so does a table without rows."""
    docs = edge.documents(spark, empty=empty)
    os.makedirs(f"{tmp_path}/sf")
    spark.createDataFrame([] if empty else [(i, i % 2, 0) for i in range(20, 45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")
    names, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == names or i == 4
        n = docs.count() if i != 3 else n
        assert (docs.count() == 0) == empty
    by = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in by)


def test_queries_and_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from lorevane.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in QUERIES}
    for name, sql in SQL.items():
        df = entry.queries()[name](spark, SF)
        names = sorted(df.columns)
        cur = con.execute(sql)
        at = {d[0]: i for i, d in enumerate(cur.description)}
        want = sorted(repr(tuple(r[at[c]] for c in names)) for r in cur.fetchall())
        assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want, name
