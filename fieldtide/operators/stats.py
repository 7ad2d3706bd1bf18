"""Exact percentiles from value histograms.

``histogram_percentiles`` ranks all values of a key in one task and is meant for values of a small domain (days,
counts). ``values_at_ranks`` has no such bound: a key's values are dealt out by range, and ranks are found by prefix
sums of two levels, first over the ranges, then inside the one range that holds a rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide.functions.indices import round_half_even_ratio
from fieldtide.session import ensure_checkpoint_dir

RANGE_ROWS = 1 << 17  # distinct values of a range, which one task sorts


def value_histogram(rows: DataFrame, key: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Counts per key, measure and value. Nulls are left out.

    This is the only step that shuffles the input, and it does so as partial counts: a key with a third of all rows
    sends at most its number of distinct values from each task.
    """
    named = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("bigint").alias("value")) for m, c in measures.items()])
    long = rows.select(*key, F.inline(named)).filter(F.col("value").isNotNull())
    return long.groupBy(*key, "measure", "value").agg(F.count(F.lit(1)).alias("freq"))


def histogram_percentiles(
    hist: DataFrame, key: Sequence[str], quantiles: Sequence[int], carry: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles rounded half to even, in integer arithmetic, one row per key and measure.

    The rank of percentile q among n sorted values is ``q * (n - 1) / 100``; the two neighbours are read off the
    cumulative counts. ``carry`` columns of the histogram are reduced by their minimum on the way.
    """
    group = [*key, "measure"]
    ordered = W.partitionBy(*group).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = hist.select(
        *group, "value", *carry, F.sum("freq").over(ordered).alias("_cum"),
        F.sum("freq").over(W.partitionBy(*group)).alias("_n"),
    )
    picks = []
    for q in quantiles:
        rank = F.lit(q) * (F.col("_n") - 1)
        k = F.floor(rank / F.lit(100)).cast("bigint")
        picks += [
            F.min(F.when(F.col("_cum") > k, F.col("value"))).alias(f"_lo{q}"),
            F.min(F.when(F.col("_cum") > k + 1, F.col("value"))).alias(f"_hi{q}"),
        ]
    found = rows.groupBy(*group).agg(F.max("_n").alias("n"), *[F.min(c).alias(c) for c in carry], *picks)
    out = []
    for q in quantiles:
        rest = (F.lit(q) * (F.col("n") - 1)) % 100
        lo, hi = F.col(f"_lo{q}"), F.coalesce(F.col(f"_hi{q}"), F.col(f"_lo{q}"))
        out.append(round_half_even_ratio(lo * (F.lit(100) - rest) + hi * rest, 100).alias(f"p{q}"))
    return found.select(*group, "n", *carry, *out)


def values_at_ranks(hist: DataFrame, key: Sequence[str], ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per key of a histogram (key, value, freq): n, and per name of ``ranks`` the value at that zero-based rank.

    ``ranks`` maps a name to a function of the count n. Values may be of any ordered type. Their ranges over the tasks
    follow a sample and are written to the checkpoint folder, so that both levels see the same ones; their number follows
    the counted rows of the histogram, about ``RANGE_ROWS`` each. Null keys are keys.
    """
    ensure_checkpoint_dir(hist.sparkSession)
    hist = hist.checkpoint()
    ranges = max(hist.sparkSession.sparkContext.defaultParallelism, -(-hist.count() // RANGE_ROWS))
    dealt = hist.repartitionByRange(ranges, *key, "value").withColumn("_part", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy(*key, "_part").agg(F.sum("freq").alias("_held"))
    whole = W.partitionBy(*key)
    ahead = F.sum("_held").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*key, "_part", "_held", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_held").over(whole).alias("n"))
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("bigint").alias("_rank")) for name, rank in ranks.items()])
    here = F.filter(asked, lambda a: (a["_rank"] >= F.col("_ahead")) & (a["_rank"] < F.col("_ahead") + F.col("_held")))
    wanted = parts.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_part").alias("_at"), "_ahead", "n", here.alias("_asked"))
    wanted = wanted.filter(F.size("_asked") > 0)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], F.col("_part") == F.col("_at"))
    inside = W.partitionBy(*key, "_part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    # The few wanted ranges are the hashed side, so that only rows of those ranges are ever sorted.
    rows = dealt.join(wanted.hint("shuffle_hash"), same).withColumn("_cum", F.sum("freq").over(inside) + F.col("_ahead"))
    rows = rows.select(*key, "n", "value", "_cum", F.inline("_asked")).filter(F.col("_cum") > F.col("_rank"))
    found = rows.groupBy(*key, "n", "_name").agg(F.min("value").alias("value"))
    return found.groupBy(*key, "n").agg(*[F.min(F.when(F.col("_name") == name, F.col("value"))).alias(name) for name in ranks])


def percentile_int(rows: DataFrame, key: Sequence[str], value: str, quantiles: Sequence[int]) -> DataFrame:
    """Percentiles of one integer column per key, whatever its domain; interpolated and rounded as above."""
    known = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("bigint").alias("value"))
    below = lambda q: lambda n: F.floor(F.lit(q) * (n - 1) / F.lit(100))
    ranks = {f"_lo{q}": below(q) for q in quantiles}
    ranks |= {f"_hi{q}": lambda n, low=below(q): F.least(low(n) + 1, n - 1) for q in quantiles}
    found = values_at_ranks(known.agg(F.count(F.lit(1)).alias("freq")), key, ranks)
    out = []
    for q in quantiles:
        rest = (F.lit(q) * (F.col("n") - 1)) % 100
        out.append(round_half_even_ratio(F.col(f"_lo{q}") * (F.lit(100) - rest) + F.col(f"_hi{q}") * rest, 100).alias(f"p{q}"))
    return found.select(*key, "n", *out)


def exact_medians(rows: DataFrame, key: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """One row per key: the median of each measure, the mean of the two middle values of an even count. Nulls and NaN are
    left out; a key without values has no row, a measure without values is null."""
    named = F.array(*[F.struct(F.lit(m).alias("_measure"), c.cast("double").alias("value")) for m, c in measures.items()])
    long = rows.select(*key, F.inline(named)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    hist = long.groupBy(*key, "_measure", "value").agg(F.count(F.lit(1)).alias("freq"))
    found = values_at_ranks(hist, [*key, "_measure"], {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)})
    middle = (F.col("_a") + F.col("_b")) / 2
    return found.groupBy(*key).agg(*[F.max(F.when(F.col("_measure") == m, middle)).alias(m) for m in measures])


def class_histogram(pixels: DataFrame, key: Sequence[str], label: str = "label") -> DataFrame:
    """Map from class label (as text) to pixel count, per key. Classes are reduced before the map is built."""
    counts = pixels.groupBy(*key, label).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col(label).cast("string").alias("label"), F.col("_n").alias("pixels"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("histogram"))
