"""Contrast stretches to 8 bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.operators.raster import any_signal


def _hundredths(value: Column) -> Column:
    """Percentiles of integers at whole percents are multiples of 0.01; snapping removes last-bit noise."""
    return F.round(value * 100) / F.lit(100.0)


def _limits(pixels: DataFrame, bands: Sequence[str], key: Sequence[str], low: int, high: int, where: Column) -> DataFrame:
    """Exact low and high percentiles per image and channel.

    The aggregate keeps counts per distinct value (16-bit data has at most 65,536), so it is merged from partial maps
    and an image may be spread over any number of tasks.
    """
    pair = F.array(F.lit(low / 100.0), F.lit(high / 100.0))
    aggs = [F.percentile(F.when(where, F.col(b)), pair).alias(f"_p_{b}") for b in bands]
    return pixels.groupBy(*key).agg(F.count_if(where).alias("_valid"), *aggs)


def _scaled(v: Column, lo: Column, hi: Column) -> Column:
    unit = F.greatest(F.least((v - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))
    return F.floor(unit * 255.0).cast("int")


def percentile_stretch(
    pixels: DataFrame, bands: Sequence[str], key: Sequence[str] = ("tile", "date"), low: int = 2, high: int = 98
) -> DataFrame:
    """Each channel from its [low, high] percentile to 0..255, truncated. A flat channel uses a span of one."""
    rows = pixels.join(_limits(pixels, bands, key, low, high, F.lit(True)), list(key))
    out = []
    for b in bands:
        lo, top = _hundredths(F.col(f"_p_{b}")[0]), _hundredths(F.col(f"_p_{b}")[1])
        hi = F.when(top <= lo, lo + 1.0).otherwise(top)
        out.append(_scaled(F.col(b), lo, hi).alias(b))
    return rows.select(*[c for c in pixels.columns if c not in bands], *out)


def display_stretch(
    pixels: DataFrame, bands: Sequence[str], key: Sequence[str] = ("tile", "date"), low: int = 2, high: int = 98,
    min_valid: int = 16,
) -> DataFrame:
    """Stretch for display: percentiles over pixels with any signal; pixels without signal stay zero.

    Images with fewer than ``min_valid`` such pixels and flat channels pass unchanged.
    """
    ok = any_signal(bands)
    rows = pixels.join(_limits(pixels, bands, key, low, high, ok), list(key))
    out = []
    for b in bands:
        lo, hi = _hundredths(F.col(f"_p_{b}")[0]), _hundredths(F.col(f"_p_{b}")[1])
        plain = (F.col("_valid") < min_valid) | (hi <= lo + 1e-6)
        span = F.when(plain, F.lit(1.0)).otherwise(hi - lo)
        shown = F.when(ok, _scaled(F.col(b), lo, lo + span)).otherwise(0)
        out.append(F.when(plain, F.col(b)).otherwise(shown).cast("int").alias(b))
    return rows.select(*[c for c in pixels.columns if c not in bands], *out)
