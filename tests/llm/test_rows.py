"""Rows that share ids, over-long labelled texts and clashing column names."""

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
import fieldtide
from fieldtide.llm import topk
from fieldtide.llm.repeats import remove_repeats
from fieldtide.llm.toxicity import labelled_sample

cloudpickle.register_pickle_by_value(fieldtide)


def test_rows_that_share_an_id_all_count(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 40, [float(x) for x in rng.normal(size=5)]) for k in range(70)] + [(20, [1.0] * 5), (20, [1.0] * 5), (20, None)]
    found = topk.top_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), F.col("vec_id") % 20 == 0,
                          k=7, block_rows=16, block_queries=2).collect()
    fine = [(i, np.floor(64 * np.float64(np.float32(v))).astype(int)) for i, v in rows if v is not None]
    expected = []
    for a, (i, v) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(fine) if a != b)[:7]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_long_labelled_texts_are_passed_over(spark):
    docs = spark.createDataFrame([(k, "word " * (5000 if k % 10 == 0 else 20)) for k in range(200)], "doc_id bigint, text string")
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    rows = labelled_sample(docs, labels, "toxic", most_words=2_000)
    texts = [bytes(r["text"]) for r in rows]
    assert len(rows) > 50 and max(map(len, texts)) == 100 and len({r["y"] for r in rows}) == 2
    assert sum(len(t) // 6 + 1 for t in texts) <= 2_000


def test_of_rows_with_one_id_the_shortest_text_is_learnt(spark):
    docs = spark.createDataFrame([(k, t) for k in range(20) for t in ("aaaa longer", "zz")], "doc_id bigint, text string")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert {bytes(r["text"]) for r in labelled_sample(docs, labels, "toxic")} == {b"zz"}


def test_clashing_columns_are_kept(spark):
    rows = [(1, "some words " * 30, "en", "a", 330, "k", "f", 9, 8, 7), (2, "other text", "en", None, 10, None, None, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _found string, _size int, _score int, _row int")
    got = remove_repeats(docs).select("doc_id", "_key", "_found").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, "k", "f"), (2, None, None)]
    for name in ("toxicity", "suffix_array_dedup", "source_mixing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        first = out.filter("doc_id = 1").select("_key", "_found", "_size", "_score", "_row").distinct().collect()
        assert [tuple(r) for r in first] == [("k", "f", 9, 8, 7)]
