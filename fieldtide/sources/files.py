"""Listings of raster folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtide.functions.dates import parse_date


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length`` of all files under a folder. Only these two columns are selected, so no content is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(root).select("path", "length")
    )


def inventory(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keys from paths ``<year>_<region>/<tile>/<date>/<band>_<date>.tif``. Paths that do not fit are left out.

    Dates must be real dates; the optional range is inclusive.
    """
    def keys(parts):
        at = lambda k: F.try_element_at(parts, F.lit(k))
        return F.struct(
            F.regexp_extract(at(-4), r"^(\d{4})_[A-Za-z]+$", 1).try_cast("int").alias("year"),
            F.when(at(-3).rlike(r"^\d+_\d+$"), at(-3)).alias("tile"), parse_date(at(-2)).alias("date"),
            F.nullif(F.regexp_extract(at(-1), r"^([A-Za-z0-9_]+?)_\d{4}-\d{2}-\d{2}\.[A-Za-z]+$", 1), F.lit("")).alias("band"),
        )

    # A generator of at most one row: the path is split and parsed once, however many filters follow.
    found = F.filter(F.transform(F.array(F.split("path", "/")), keys), lambda k: k["tile"].isNotNull() & k["date"].isNotNull())
    rows = files.select("path", "length", F.inline(found))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows


def available_years(files: DataFrame, window: str, feature_set: str, name: str) -> DataFrame:
    """Years having the artifact ``name``, with its path: ``output_<y>/<window>/<features>/`` before ``<y>/``."""
    new = F.regexp_extract("path", rf"/output_(\d{{4}})/{window}/{feature_set}/{name}$", 1)
    old = F.regexp_extract("path", rf"/(\d{{4}})/{window}/{feature_set}/{name}$", 1)
    rows = files.select(
        "path", F.when(new != "", new).otherwise(old).try_cast("int").alias("year"),
        F.when(new != "", 0).otherwise(1).alias("rank"),
    ).filter(F.col("year").isNotNull())
    return rows.groupBy("year").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def artifact_path(root: str, year: int, window: str, feature_set: str, name: str, legacy: bool = False) -> str:
    """Default location of an artifact; the new layout unless ``legacy``."""
    folder = str(year) if legacy else f"output_{year}"
    return "/".join([root.rstrip("/"), folder, window, feature_set, name])


def tile_footprint(files: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Raster that gives each tile's footprint: ``cdl.tif`` if present, else the first B4 file in path order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    tile = F.regexp_extract("path", r"/(\d+_\d+)/", 1)
    rows = files.select("path", tile.alias("tile"), (name == "cdl.tif").alias("_cdl"), name.rlike(r"^B4_.*\.tif$").alias("_b4"))
    rows = rows.filter((F.col("tile") != "") & (F.col("_cdl") | F.col("_b4")))
    best = rows.groupBy("tile").agg(F.min_by("path", F.struct(F.when(F.col("_cdl"), 0).otherwise(1), "path")).alias("path"))
    return best.join(bounds, "path", "left") if bounds is not None else best

