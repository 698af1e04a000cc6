"""The pipeline's stages on awkward rows, and that the queries are whole."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, rows

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    made = rows()
    spark.createDataFrame(made, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    bench = next(r[1] for r in made if r[0] == 5)
    spark.createDataFrame([(1, bench), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    ids = {r.doc_id for r in docs.collect()}
    assert 103 not in ids and 101 not in ids and 5 not in ids and 106 in ids
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == ids


def test_empty_table(spark, folder, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_extra_columns_stay(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_stage_methods_are_the_five_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
