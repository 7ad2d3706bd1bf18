"""Splitting images into overlapping chunks for a model, and blending the results."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.operators.raster import any_signal

__all__ = ["any_signal", "chunk_positions", "chunk_pixels", "pad_chunks", "chunk_weight", "weighted_blend", "stitch_chunks"]


def chunk_positions(size: Column, tile: int, step: int) -> Column:
    """Start positions 0, step, 2 step ... plus a last chunk flush with the edge; one chunk when the image fits."""
    last = F.greatest(size - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def _starts_covering(p: Column, size: Column, tile: int, step: int) -> Column:
    """Starts of the chunks that contain position ``p``, by arithmetic rather than by searching all chunks."""
    last = F.greatest(size - tile, F.lit(0))
    first = F.greatest(F.ceil((p - tile + 1) / F.lit(step)), F.lit(0)).cast("int")
    stop = F.floor(F.least(p, last) / F.lit(step)).cast("int")
    regular = F.when(first <= stop, F.transform(F.sequence(first, stop), lambda k: k * step)).otherwise(
        F.array().cast("array<int>")
    )
    flush = F.when((p >= last) & (last % step != 0), F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.concat(regular, flush)


def chunk_pixels(
    pixels: DataFrame, sizes: DataFrame, tile: int, overlap: int = 0, key: Sequence[str] = ("tile",)
) -> DataFrame:
    """Each pixel copied to every chunk containing it, with its local ``r``, ``c`` and the chunk's real ``h``, ``w``.

    The number of copies is set by the overlap alone.
    """
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and smaller than the chunk")
    step = max(1, tile - overlap)
    rest = [c for c in pixels.columns if c not in (*key, "row", "col")]
    rows = pixels.join(sizes.select(*key, "height", "width"), list(key))
    rows = rows.select("*", F.explode(_starts_covering(F.col("row"), F.col("height"), tile, step)).alias("chunk_row"))
    rows = rows.select("*", F.explode(_starts_covering(F.col("col"), F.col("width"), tile, step)).alias("chunk_col"))
    return rows.select(
        *key, "chunk_row", "chunk_col", (F.col("row") - F.col("chunk_row")).alias("r"),
        (F.col("col") - F.col("chunk_col")).alias("c"),
        F.least(F.col("height") - F.col("chunk_row"), F.lit(tile)).alias("h"),
        F.least(F.col("width") - F.col("chunk_col"), F.lit(tile)).alias("w"), *rest,
    )


def _padded(p: Column, n: Column, size: int, reflect: Column) -> Column:
    """Positions of a padded chunk that show source position ``p`` of ``n``."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    fold = lambda q: F.when(q % period < n, q % period).otherwise(period - q % period)
    shown = F.filter(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda q: F.when(q < n, q == p).when(reflect, fold(q) == p).otherwise(p == n - 1),
    )
    return F.when(n >= size, F.array(p)).otherwise(shown)


def pad_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Fill short chunks to ``size`` by reflection without repeating the edge, or by copying the edge when a side is 1.

    Every pixel emits its own mirror positions, so padding needs no join. Padded rows have ``padded`` set.
    """
    reflect = (F.col("h") > 1) & (F.col("w") > 1)
    rows = chunks.withColumn("_r", F.explode(_padded(F.col("r"), F.col("h"), size, reflect)))
    rows = rows.withColumn("_c", F.explode(_padded(F.col("c"), F.col("w"), size, reflect)))
    return rows.withColumns({
        "padded": (F.col("_r") >= F.col("h")) | (F.col("_c") >= F.col("w")), "r": F.col("_r"), "c": F.col("_c"),
    }).drop("_r", "_c")


def _ramp(p: Column, size: int) -> Column:
    return F.greatest(F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2.0 * math.pi) * p / F.lit(float(size - 1))), F.lit(1e-3))


def chunk_weight(r: Column, c: Column, size: int) -> Column:
    """Centre-heavy weight: product of two raised-cosine ramps with a small floor; 1 for a one-pixel chunk."""
    return F.lit(1.0) if size <= 1 else _ramp(r, size) * _ramp(c, size)


def weighted_blend(
    chunks: DataFrame, size: int, bands: Sequence[str], key: Sequence[str] = ("tile",), low: int = 0, high: int = 255
) -> DataFrame:
    """Overlapping chunk values to one image: weighted mean, rounded half to even, clipped.

    Chunk rows carry ``chunk_row, chunk_col, r, c``; the reduction is a partial sum per pixel.
    """
    w = chunk_weight(F.col("r"), F.col("c"), size)
    rows = chunks.select(
        *key, (F.col("chunk_row") + F.col("r")).alias("row"), (F.col("chunk_col") + F.col("c")).alias("col"),
        w.alias("_w"), *bands,
    )
    value = lambda b: F.rint(F.round(F.sum(F.col("_w") * F.col(b)) / F.greatest(F.sum("_w"), F.lit(1e-6)), 9))
    return rows.groupBy(*key, "row", "col").agg(
        *[F.greatest(F.least(value(b), F.lit(float(high))), F.lit(float(low))).cast("int").alias(b) for b in bands]
    )


def stitch_chunks(
    chunks: DataFrame, size: int, overlap: int, bands: Sequence[str], key: Sequence[str] = ("tile",)
) -> DataFrame:
    """Model output back to images: padding dropped, chunks placed side by side or blended when they overlap."""
    real = chunks.filter(~F.col("padded")) if "padded" in chunks.columns else chunks
    if overlap:
        return weighted_blend(real, size, bands, key)
    return real.select(
        *key, (F.col("chunk_row") + F.col("r")).alias("row"), (F.col("chunk_col") + F.col("c")).alias("col"), *bands
    ).dropDuplicates([*key, "row", "col"])


def chunk_arrays(chunks: DataFrame, bands: Sequence[str], key: Sequence[str] = ("tile",)) -> DataFrame:
    """One row per chunk with ``x``: pixel values in row-major order, band after band. A chunk has a fixed size."""
    k = [*key, "chunk_row", "chunk_col"]
    packed = chunks.groupBy(*k).agg(
        F.array_sort(F.collect_list(F.struct("r", "c", *bands))).alias("_p"),
        F.max("h").alias("h"), F.max("w").alias("w"),
    )
    layer = lambda b: F.transform("_p", lambda p: p[b].cast("float"))
    flat = F.concat(*[layer(b) for b in bands])
    return packed.select(*k, "h", "w", flat.alias("x"))
