"""The corpus queries that have SQL give its rows; the pipeline runs and keeps its promises."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from stroma.llm.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(SQL[name])
    have = QUERIES[name](spark, SMALL).select(*want.columns).collect()
    assert Counter(map(tuple, have)) == Counter(want.fetchall())


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
    assert pipeline.run(spark, SMALL).count() > 0


def test_one_row_of_repeated_documents_stays(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    twice = docs.unionByName(docs)
    assert pipeline.near_dedup(spark, twice, SMALL).count() == pipeline.near_dedup(spark, docs, SMALL).count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_key string, _gone_id long, score int, spans string, passages int, _quality int, _passages string, quality string"


def odd_documents(spark):
    one = " ".join(f"word{k}" for k in range(60))
    long = " ".join(f"long{k}" for k in range(90)) + " x" * 200_000
    rows = [(1, one), (2, one), (3, None), (4, ""), (5, long), (5, long), (6, f"db_pwd = 'X9kLm2Qp7RtZ4vB1' {one[:200]}"), (6, "another text of the same id, which stays"), (None, one), (None, None), (7, "  \n\t ")]
    return spark.createDataFrame([(i, t, "en", None, None, True, "k", 1, 2, "s", 3, 4, "p", "q") for i, t in rows], ODD)


def test_stages_take_odd_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_documents(spark)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    all_of_them = texts(docs)
    for name, stage in pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0), docs.where("text is null")):
            out = stage(spark, part, SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            if name != "without_secrets":
                assert texts(out) <= texts(part), name
            else:
                assert out.count() == part.count()
    left = texts(pipeline.near_dedup(spark, docs, SMALL))
    gone = all_of_them - left
    assert {k[0] for k in gone} == {2, 5} and left[5, next(t for i, t in all_of_them if i == 5)] == 1 and sum(v for k, v in left.items() if k[0] is None) == 2
    assert sum(v for k, v in left.items() if k[0] == 6) == 2
    packed = pipeline.packed(spark, docs, SMALL).toPandas()
    assert set(packed.doc_id.dropna()) == {1, 2, 3, 4, 5, 6, 7} and pipeline.packed(spark, docs.limit(0), SMALL).count() == 0
