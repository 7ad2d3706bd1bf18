"""Quality of acquisition dates: cloud, blank and black shares, gates, composites and channel statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide import constants as C
from fieldtide.functions import indices as X

IMAGE = ("tile", "date")


def cloud_stats(pixels: DataFrame, bands: Sequence[str] = ("B2", "B3", "B4"), black_threshold: int = 0) -> DataFrame:
    """Shares per image: cloud of all pixels, cloud of classified pixels, blank (all bands 0), black (all <= threshold).

    Counting is a partial aggregate; an image may be spread over any number of tasks.
    """
    cols = [F.col(b) for b in bands]
    every = lambda test: F.count_if(_all([test(c) for c in cols]))
    scl, n = F.col("scl"), F.count(F.lit(1))
    cloudy = F.count_if(scl > C.SCL_CLOUD_ABOVE)
    classified = F.count_if(scl > 0)
    return pixels.groupBy(*IMAGE).agg(
        n.alias("pixels"), (cloudy / n).alias("cloud_fraction"),
        F.coalesce(F.try_divide(cloudy.cast("double"), classified.cast("double")), F.lit(1.0)).alias("scl_cloud_ratio"),
        (every(lambda c: c == 0) / n).alias("blank_fraction"),
        (every(lambda c: c <= black_threshold) / n).alias("black_ratio"),
    )


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def gate_flags(
    stats: DataFrame, cloud_max: float = C.CLOUD_FRAC_MAX, blank_max: float | None = C.BLANK_FRAC_MAX
) -> DataFrame:
    ok = F.col("cloud_fraction") <= cloud_max
    if blank_max is not None:
        ok = ok & (F.col("blank_fraction") <= blank_max)
    return stats.withColumn("valid", ok)


def quality_gate(
    pixels: DataFrame, cloud_max: float = C.CLOUD_FRAC_MAX, blank_max: float | None = C.BLANK_FRAC_MAX
) -> DataFrame:
    """Pixels of the images that pass the gate (semi-join on the image)."""
    good = gate_flags(cloud_stats(pixels), cloud_max, blank_max).filter("valid").select(*IMAGE)
    return pixels.join(good, list(IMAGE), "left_semi")


def quality_gate_export(
    pixels: DataFrame, max_cloud: float | None, max_black: float | None, black_threshold: int = 0
) -> DataFrame:
    """Export rule: cloud among classified pixels first, then the black share. Adds ``keep`` and ``reason``."""
    stats = cloud_stats(pixels, black_threshold=black_threshold)
    reason = F.lit(None).cast("string")
    if max_black is not None:
        reason = F.when(F.col("black_ratio") > max_black, "black").otherwise(reason)
    if max_cloud is not None:
        reason = F.when(F.col("scl_cloud_ratio") > max_cloud, "cloud").otherwise(reason)
    return stats.select(
        *IMAGE, "scl_cloud_ratio", "black_ratio", reason.alias("reason"), reason.isNull().alias("keep")
    )


def complete_dates(long_pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(tile, date) pairs for which every required band exists."""
    have = long_pixels.filter(F.col("band").isin(*bands)).groupBy(*IMAGE, "band").agg(F.lit(1).alias("_x"))
    return have.groupBy(*IMAGE).agg(F.count("band").alias("_n")).filter(F.col("_n") == len(bands)).select(*IMAGE)


def monthly_median(
    pixels: DataFrame, scenes: DataFrame | None = None, bands: Sequence[str] = ("B2", "B3", "B4", "B8"),
    mask_water: bool = False, month: Column | None = None,
) -> DataFrame:
    """Median composite per tile, month and pixel over the kept pixels of the chosen scenes.

    Medians of integers are rounded half up and clamped into the unsigned range: 8 bits for the class layer and true
    colour, 16 bits otherwise. The exact median counts distinct values, at most one per scene of the month.
    """
    rows = pixels
    if scenes is not None:
        rows = rows.join(scenes.select(*IMAGE).distinct(), list(IMAGE), "left_semi")
    keep = X.scl_valid(F.col("scl"), "keep", mask_water)
    tag = F.date_format("date", "yyyy-MM") if month is None else month
    eight = lambda b: b.lower() == "scl" or b.startswith("TCI_")
    return rows.filter(keep).groupBy("tile", tag.alias("month"), "row", "col").agg(
        *[X.clamp_unsigned(F.floor(F.median(b) + F.lit(0.5)), 8 if eight(b) else 16).alias(b) for b in bands]
    )


def scene_counts(scenes: DataFrame, key: Sequence[str] = ("tile",), date: str = "date") -> DataFrame:
    """Number of scenes and the sorted distinct dates per key. Distinct dates are reduced before they are collected."""
    per_day = scenes.groupBy(*key, date).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.groupBy(*key).agg(
        F.sum("_n").alias("scenes"), F.array_sort(F.collect_list(date)).alias("dates")
    )


def select_scenes(
    scenes: DataFrame, start, end_exclusive, cloud_below: float, box: dict[str, float] | None = None
) -> DataFrame:
    """Half-open date range, strict cloud limit and box overlap."""
    out = scenes.filter(
        (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end_exclusive)) & (F.col("cloud") < cloud_below)
    )
    if box is not None:
        out = out.filter(
            (F.col("lon_min") <= box["lon_max"]) & (F.col("lon_max") >= box["lon_min"])
            & (F.col("lat_min") <= box["lat_max"]) & (F.col("lat_max") >= box["lat_min"])
        )
    return out


def cut_by_max_doy(rows: DataFrame, max_doy: Column, date: str = "date") -> DataFrame:
    return rows.filter(F.dayofyear(date) <= max_doy)


def channel_stats(pixels: DataFrame, channels: Sequence[str], key: Sequence[str] = IMAGE) -> DataFrame:
    """Per key and channel: min, max, mean, non-zero count, pixel count and the share of pixels with any signal.

    All channels are reduced in one aggregate over the wide rows and unpivoted afterwards.
    """
    aggs = []
    for c in channels:
        aggs += [
            F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"), F.avg(c).alias(f"_mean_{c}"),
            F.count_if(F.col(c) != 0).alias(f"_nz_{c}"),
        ]
    any_signal = ~_all([F.col(c) <= 0 for c in channels])
    wide = pixels.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(any_signal).alias("signal_pixels"), *aggs
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("channel"), F.col(f"_min_{c}").alias("min"), F.col(f"_max_{c}").alias("max"),
            F.col(f"_mean_{c}").alias("mean"), F.col(f"_nz_{c}").alias("nonzero"),
        )
        for c in channels
    ])
    return wide.select(
        *key, "pixels", (F.col("signal_pixels") / F.col("pixels")).alias("signal_fraction"), F.inline(rows)
    )
