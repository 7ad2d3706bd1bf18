"""Incremental ingestion, rolling coverage and job state as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_observations(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, max_files: int = 1000,
    partition_by: tuple[str, ...] = ("year",),
) -> StreamingQuery:
    """Append new Parquet files of a folder to an observations table exactly once, then stop.

    The checkpoint folder records which files were taken; both folders must be shared storage on a cluster. Files are
    taken in bounded batches.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        stream.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def rolling_coverage(scenes: DataFrame, late_days: int = 5, time: str = "ts", tile: str = "tile", exact: bool = False) -> DataFrame:
    """Tiles seen per acquisition day; scenes up to ``late_days`` late are still counted.

    The count of tiles is approximate; ``exact`` keeps the day's set of tiles in the state, which a tile grid bounds.
    """
    tiles = F.size(F.collect_set(tile)).cast("bigint") if exact else F.approx_count_distinct(tile)
    return (
        scenes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{late_days} days").groupBy(F.window(time, "1 day").alias("day"))
        .agg(tiles.alias("tiles"), F.count(F.lit(1)).alias("scenes"))
        .select(F.col("day.start").cast("date").alias("date"), "tiles", "scenes")
    )


def exact_coverage(scenes: DataFrame, late_days: int = 5, time: str = "ts", tile: str = "tile") -> DataFrame:
    """The first sighting of each tile per day, duplicates dropped within the watermark: count its rows downstream."""
    day = F.date_trunc("day", F.col(time).cast("timestamp"))
    return (
        scenes.select(day.alias("day"), F.col(tile).alias("tile")).withWatermark("day", f"{late_days} days")
        .dropDuplicates(["day", "tile"])
    )


def latest_job_state(jobs: DataFrame, key: str = "job_key", updated: str = "updated_at", ident: str = "job_id") -> DataFrame:
    """Newest status per key; use update mode. State holds one row per key."""
    best = F.max(F.struct(F.col(updated).alias("updated_at"), F.col(ident).alias("job_id"), F.col("state").alias("state")))
    return jobs.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def keep_latest(stream: DataFrame, target: str, checkpoint: str, key: str = "job_key") -> DataFrame:
    """Run a keyed aggregate in update mode to its end, and return its newest row per key.

    Every micro-batch replaces a folder of its own below ``target`` with the rows it changed, so a batch that is run again
    after a failure leaves the same rows. The last batch of a key holds its state.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(target).drop("batch")
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(key, "_r.*")


def land(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append everything the stream has now to a Parquet folder exactly once, and return the folder as a table.

    Works for streams in append mode. Aggregates over the landed rows can then be computed and corrected as batches,
    and nothing passes through the driver.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(target)
