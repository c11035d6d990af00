from __future__ import annotations

import pytest

import corpus_pipeline
from tarnlight.llm import queries


def test_stages_on_their_own_input(spark, tmp_path):
    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        ids = left
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_empty_and_odd_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "good text of some words\n\ngood text of some words", "en", "s", 5)], whole.schema)
    for docs in (whole.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", ["op8_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.queries()[name](spark, sf)
    want = c.execute(queries.oracle_sql()[name]).df()
    got = df.toPandas()[list(want.columns)]
    key = ["doc_id"]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()
