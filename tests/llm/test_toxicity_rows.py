from pyspark.sql import functions as F

from fieldtide.llm import toxicity


def test_every_labelled_row_is_learned_from(spark):
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, F.repeat(F.lit("long "), 700_000)).otherwise("word").alias("text"))
    labels = spark.range(7000).selectExpr("id AS doc_id", "id % 2 AS toxic")
    rows = toxicity.labelled_rows(docs, labels, "toxic", 3)
    wanted = docs.filter(~toxicity.held_out("doc_id"))
    assert rows.select("_id").exceptAll(wanted.select("doc_id")).isEmpty() and rows.count() == wanted.count()
    assert rows.select("_part").distinct().count() == 3


def test_rows_of_known_buckets_take_little_memory():
    import tracemalloc

    import numpy as np

    from fieldtide.llm.toxicity import BUCKETS, WordBuckets

    known = np.arange(5, BUCKETS, 5)
    tracemalloc.start()
    try:
        table = WordBuckets(known)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 6_000_000
    plain = WordBuckets()
    rows = {int(b): k + 1 for k, b in enumerate(known)}
    words = [b"w%d" % i for i in range(2000)]
    assert [table[w] for w in words] == [rows.get(plain[w], 0) for w in words]
