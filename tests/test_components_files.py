from fieldtide.operators.components import roots


def test_few_edges_take_few_files_a_round(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(300).filter("id % 10 <> 9").selectExpr("id AS u", "id + 1 AS v")
        found = roots(edges, ())
        assert {(r["node"], r["root"]) for r in found.collect()} == {(k, k - k % 10) for k in range(300) if k % 10}
        assert found.rdd.getNumPartitions() == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
