"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide.llm.work import WORD


def targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(source, source_size, rows, target) from one row per source (source, source_size, rows).

    Sources by code point, null last, weigh ``weights`` in turn and split ``share`` times all sizes. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight until none is above. Sorted by the
    level at which they fill up, the full sources come first, so one pass over running sums settles all of them. The
    windows see one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("w", F.element_at(table, (turn % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = W.partitionBy()
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumns({"total": total, "full": F.col("cap") * F.sum("w").over(onward) <= F.col("w") * left})
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)
    rows = rows.withColumns({"taken": taken, "weight": weight})
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - F.col("taken")) * F.col("w") / F.col("weight"))
    return rows.select("source", "source_size", "rows", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): 32 bits of an MD5 of the seed and the source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", share: float = 1.5,
        weights: Sequence[int] = (3, 1, 2), most: float = 2.0, seed: int = 11, per_bucket: int = 2_000) -> DataFrame:
    """``docs`` with ``_size`` (words), ``_source_size``, ``_target`` and ``_copies``.

    A document of a source is expected target / source_size times. The expected copies are summed up through the source
    after one random offset, and a document is emitted once per whole number that its part of the sum crosses. A source
    is ordered by buckets of about ``per_bucket`` rows and in them by size, up and down in turn, so that each stretch of
    the sum holds documents of all sizes; sums run inside buckets and the buckets' totals are added, so no task holds a
    source. Null texts have no words; null sources are a source; repeated rows count each. Reruns agree.
    """
    # Size and tie-break are taken at the scan, so that a caller who drops the text shuffles none of it.
    rows = docs.withColumns({"_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"), "_tie": F.xxhash64(text)})
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(sizes, share, weights, most).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        (F.floor(F.col("rows") / per_bucket) + 1).alias("_buckets"))
    rows = rows.join(plan, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)) + F.col("_size")
    rows = rows.withColumn("_bucket", F.pmod(number, F.col("_buckets")))
    counts = rows.groupBy(F.col(source).alias("_source"), F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = F.sum("_rows").over(W.partitionBy("_source").orderBy("_of").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_source", "_of", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    rows = rows.join(counts, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    swing = F.when(F.col("_bucket") % 2 == 0, F.col("_size")).otherwise(-F.col("_size"))
    place = F.row_number().over(W.partitionBy(source, "_bucket").orderBy(swing, doc_id, "_tie")) + F.col("_ahead")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    upto = lambda k: F.floor(offset(F.col(source), seed) + rate * k)
    rows = rows.withColumn("_place", place)
    rows = rows.withColumn("_copies", upto(F.col("_place")) - upto(F.col("_place") - 1))
    return rows.drop("_source", "_of", "_ahead", "_bucket", "_buckets", "_place", "_tie")


def emit(mixed: DataFrame) -> DataFrame:
    """Every row of ``mix`` as often as it is taken, without the columns ``mix`` added."""
    rows = mixed.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return rows.drop("_size", "_source_size", "_target", "_copies", "_copy")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM rows GROUP BY source),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM sizes),
filled AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM weighed),
aims AS (
  SELECT source, source_size, n, CASE WHEN is_full THEN cap ELSE
    (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
  FROM filled),
dealt AS (
  SELECT r.doc_id, r.source, r.size, a.source_size, a.target,
         (coalesce(r.doc_id, 0) + r.size) % (a.n // 2000 + 1) AS bucket
  FROM rows r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, doc_id) AS k,
         CAST('0x' || substr(md5('11:' || coalesce('s' || source, '')), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM dealt)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * k) - floor(u + rate * (k - 1))) * size)::BIGINT AS taken
FROM placed
"""
