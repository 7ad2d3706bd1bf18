"""Reading pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtide.operators.quality import complete_dates


def _bands_path(path: str) -> str:
    return path.rstrip("/") + ".bands"


def read_pixels(
    spark: SparkSession, path: str, bands: Sequence[str], tiles: Sequence[str] | None = None,
    start: str | None = None, end: str | None = None, inventory: bool = True,
) -> DataFrame:
    """Chosen bands of a wide pixel table. Tile and date filters reach the partitions and row groups.

    An image (tile and date) for which a band is absent from all its pixels is skipped. Which these are stands in the
    band inventory that ``write_pixels`` leaves beside the table: a small table, whose semi-join on the partition columns
    prunes folders at run time. Without an ``inventory`` the pixels themselves are counted, in a second scan.
    """
    df = spark.read.parquet(path)

    def chosen(rows: DataFrame) -> DataFrame:
        if tiles is not None:
            rows = rows.filter(F.col("tile").isin(*tiles))
        if start is not None:
            rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
        return rows

    keep = ["tile", "date", "row", "col", *bands] + (["scl"] if "scl" in df.columns else [])
    if inventory:
        listed = chosen(spark.read.parquet(_bands_path(path)))
        whole = listed.filter(F.size(F.array_except(F.array(*[F.lit(b) for b in bands]), "bands")) == 0).select("year", "tile", "date")
        return chosen(df).join(whole, ["year", "tile", "date"], "left_semi").select(*keep)
    df = chosen(df).select(*keep)
    have = df.groupBy("tile", "date").agg(*[F.count(b).alias(b) for b in bands])
    whole = have.filter(" and ".join(f"`{b}` > 0" for b in bands)).select("tile", "date")
    return df.join(whole, ["tile", "date"], "left_semi")


def band_inventory(pixels: DataFrame) -> DataFrame:
    """(year, tile, date, bands): the bands of which an image has any value."""
    bands = [c for c in pixels.columns if c not in ("year", "tile", "date", "row", "col", "scl")]
    have = pixels.groupBy(F.year("date").alias("year"), "tile", "date").agg(*[F.count(b).alias(b) for b in bands])
    present = F.array_compact(F.array(*[F.when(F.col(b) > 0, F.lit(b)) for b in bands]))
    return have.select("year", "tile", "date", present.alias("bands"))


def pivot_bands(long_pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Long rows ``band, value`` to wide pixels; images lacking a required band are skipped.

    The band list is given, so the pivot needs no extra pass to discover it.
    """
    images = complete_dates(long_pixels, bands)
    rows = long_pixels.join(images, ["tile", "date"], "left_semi")
    return rows.groupBy("tile", "date", "row", "col").pivot("band", list(bands)).agg(F.first("value"))


def write_pixels(pixels: DataFrame, path: str, block: int = 256, mode: str = "errorifexists") -> None:
    """Pixels partitioned by year and tile, sorted by date and block so that windowed reads prune row groups.

    The rows are range-partitioned on the full sort order: a task meets few tiles, and a tile holding a large share of
    all rows is split over many tasks. The band inventory of the written table follows beside it.
    """
    order = ("year", "tile", "date", "_b")
    rows = pixels.withColumns({
        "year": F.year("date"), "_b": F.floor(F.col("row") / block) * 100000 + F.floor(F.col("col") / block),
    })
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.drop("_b").write.mode(mode).partitionBy("year", "tile").parquet(path)
    spark = pixels.sparkSession
    band_inventory(spark.read.parquet(path)).write.mode("overwrite").parquet(_bands_path(path))


def save_bucketed(pixels: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Save a pixel or mask table bucketed by pixel position.

    Tables with the same number of buckets join on (tile, row, col) without a shuffle, and per-pixel composites group
    without one. Positions hash evenly even when one tile holds most rows.
    """
    key = ("tile", "row", "col")
    writer = pixels.repartition(buckets, *key).write.mode(mode).bucketBy(buckets, *key).sortBy(*key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
