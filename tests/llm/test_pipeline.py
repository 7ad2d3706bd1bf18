"""The corpus pipeline: every stage keeps the columns of documents, and its decisions take effect."""

import pytest

import corpus_pipeline
from fieldtide.llm.work import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
            assert docs.filter("n_chars <> length(text)").count() == 0
        assert {r[0] for r in docs.select("doc_id").distinct().collect()} <= ids
    assert counts[0] > counts[1] >= counts[2] == counts[3] > 0
    assert docs.filter("n_pieces <> size(ids)").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
