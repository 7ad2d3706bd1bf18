import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtide.llm import toxicity
from fieldtide.llm.work import release, saved, written


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(900):
        toxic = k % 5 == 0
        own = rng.choices(words, k=rng.randrange(0, 60)) + ["foul", "rude", "vile"] * (toxic and k % 10 == 0) + ["foul"] * toxic
        rng.shuffle(own)
        rows.append((k, " ".join(own), int(toxic)))
    rows.append((900, " ".join(rng.choices(words, k=9_000)), 0))
    return rows


def assert_all_passes(held, known, odds, got):
    """``got`` is the mean of what each of two parts makes of four passes."""
    buckets, first, moved = toxicity.WordBuckets(), toxicity.informed(known, odds), []
    for part in sorted({r["_part"] for r in held}):
        own = [r for r in held if r["_part"] == part]
        assert len(own) > 2_200  # so that 4 passes are more than the least number of steps
        ids = [toxicity.word_ids(bytes(r["text"]), buckets, 3) for r in own]
        model = toxicity.train(ids, np.array([r["y"] for r in own]), epochs=4, start=(known, odds))
        moved.append([a - b for a, b in zip(toxicity._dense(model), toxicity._dense(first))])
    assert len(moved) == 2
    for have, start, *both in zip(toxicity._dense(got), toxicity._dense(first), *moved):
        np.testing.assert_allclose(have - start, sum(both) / 2, rtol=0, atol=2e-6)


def test_every_part_is_trained_by_all_passes(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices("abcdefghij", k=4)) + " foul" * (k % 4 == 0)) for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.range(10_000).selectExpr("id AS doc_id", "int(id % 5 = 0) AS toxic")
    before = written()
    rows = saved(toxicity.labelled_rows(docs, labels, "toxic", 2), "test-rows").filter("not calibration")
    held = rows.withColumn("o", F.xxhash64("_id", F.lit(20260101))).orderBy("_part", "o", "_id").collect()
    y = np.array([r["y"] for r in held])
    known, odds = toxicity._counted(rows, np.array([(y == 0).sum(), (y > 0).sum()], float))
    got = toxicity._trained(rows, known, odds)
    release(spark, [p for p in written() if p not in before])

    assert_all_passes(held, known, odds, got)


def test_texts_in_blocks_have_the_words_and_scores_of_single_ones(texts):
    raw = [r[1].encode() for r in texts] + [b"", b"  ", "Übel! it's\tFOUL".encode(), b"x" * 24 + b" " + b"y" * 25 + b" foul"]
    labels = np.array([float(r[2]) for r in texts] + [0.0, 0, 1, 1])
    plain = toxicity.WordBuckets()
    single = [toxicity.word_ids(t, plain, 3) for t in raw]
    assert all(np.array_equal(a, b) for a, b in zip(single, toxicity.words_of(raw, toxicity.WordBuckets(), 3, block=500), strict=True))
    model = toxicity.train(single, labels)
    known, tables = toxicity.WordBuckets(model.known), model.tables()
    ids = toxicity.words_of(raw, known, model.widest)
    one_by_one = [model.score(toxicity.word_ids(t, known, model.widest), tables) for t in raw]
    for block in (1, 64, 8192):
        assert model.scores(ids, tables, model.stacked(tables), block) == one_by_one


def test_the_pipeline_trains_every_part_by_all_passes(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("abcdefghij", k=4)) + " foul" * (k % 4 == 0), "en") for k in range(13_000)]
    spark.range(13_000).selectExpr("id AS doc_id", "int(id % 5 = 0) AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    seen, plain = [], toxicity._trained

    def trained(own, known, odds, *rest):
        model = plain(own, known, odds, *rest)
        held = own.withColumn("o", F.xxhash64("_id", F.lit(20260101))).orderBy("_part", "o", "_id").collect()
        seen.append((held, known, odds, model))
        return model

    monkeypatch.setattr(toxicity, "_trained", trained)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).columns == docs.columns
    assert_all_passes(*seen[0])
