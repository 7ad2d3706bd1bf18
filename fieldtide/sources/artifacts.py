"""Publishing prediction artifacts so that a reader never sees half of one.

A version is written to a folder of its own, read back and checked. Only then a commit names it: one row in a file that
Spark's writer moves into place in one step. Readers follow the newest commit, so a writer that fails before it leaves
them the version before, and one that runs again leaves no trace but an unnamed folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtide.operators.harvest import artifact_bounds
from fieldtide.sources.sinks import write_artifact_metadata, write_predictions
from fieldtide.sources.tables import read_predictions, read_tile_bounds

_COMMIT = "version string, committed_at timestamp"


def stage_artifact(predictions: DataFrame, document: DataFrame, tiles: DataFrame, path: str) -> str:
    """Write predictions, the document and the bounds of the predicted tiles as a new version; returns its name."""
    version = uuid.uuid4().hex
    folder = version_folder(path, version)
    write_predictions(predictions, f"{folder}/predictions")
    write_artifact_metadata(document, folder, artifact_bounds(predictions, tiles))
    return version


def version_folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}"


def check_artifact(spark: SparkSession, folder: str) -> None:
    """Raises unless a version reads back without violations, holds the rows that its document counts, and knows the
    bounds of every predicted tile."""
    good, bad = read_predictions(spark, f"{folder}/predictions")
    if not bad.isEmpty():
        raise ValueError(f"predictions with violations in {folder}")
    document = spark.read.schema("year int, prediction_row_count bigint").json(f"{folder}/document")
    counted = good.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
    off = counted.join(document, "year", "full").filter(~F.col("rows").eqNullSafe(F.col("prediction_row_count")))
    if not off.isEmpty():
        raise ValueError(f"counts of the document and the predictions differ in {folder}")
    bounds, _ = read_tile_bounds(spark, f"{folder}/tile_bounds", rows=True)
    if not good.join(bounds, "tile", "left_anti").isEmpty():
        raise ValueError(f"predicted tiles without bounds in {folder}")


def commit_artifact(spark: SparkSession, path: str, version: str) -> None:
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/commits")


def publish_artifact(predictions: DataFrame, document: DataFrame, tiles: DataFrame, path: str) -> str:
    """Stage, check and commit a version."""
    spark = predictions.sparkSession
    version = stage_artifact(predictions, document, tiles, path)
    check_artifact(spark, version_folder(path, version))
    commit_artifact(spark, path, version)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """The version named last; of commits of one instant, the last by name. Raises when nothing is published."""
    try:
        newest = spark.read.schema(_COMMIT).json(f"{path.rstrip('/')}/commits").agg(F.max(F.struct("committed_at", "version")).alias("c")).first()
    except AnalysisException:
        newest = None
    if newest is None or newest["c"] is None:
        raise FileNotFoundError(f"nothing published in {path}")
    return newest["c"]["version"]


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, document, tiles with bounds) of the current version."""
    folder = version_folder(path, current_version(spark, path))
    tiles, _ = read_tile_bounds(spark, f"{folder}/tile_bounds", rows=True)
    return read_predictions(spark, f"{folder}/predictions")[0], spark.read.json(f"{folder}/document"), tiles.distinct()
