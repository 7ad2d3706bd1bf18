"""Readers of prediction tables, artifact documents, scene manifests, summaries and model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtide import constants as C, schemas
from fieldtide.functions.dates import parse_date
from fieldtide.functions.geometry import ring_envelope
from fieldtide.functions.text import blank_to_null, to_double_lenient
from fieldtide.operators.harvest import with_violation

_REQUIRED = ("year", "tile", "crop", "pred_start_doy", "pred_end_doy")
_COUNT_ALIASES = ("num_observations", "cnn_num_observations", "rnn_num_observations")


def read_predictions(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations) of a prediction CSV. With ``strict`` any violation raises.

    All columns are read as text and cast leniently, so a bad cell marks its row instead of failing the scan. The
    observation count takes the first alias column that is filled.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(_REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"missing required columns {missing}")
    number = lambda c: blank_to_null(F.col(c)).try_cast("int")
    aliases = [blank_to_null(F.col(c)) for c in _COUNT_ALIASES if c in raw.columns]
    count = F.coalesce(*aliases).try_cast("int") if aliases else F.lit(None).cast("int")
    mae = to_double_lenient(F.col("model_test_mae_days")) if "model_test_mae_days" in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        number("year").alias("year"), F.trim("tile").alias("tile"), F.trim("crop").alias("crop"),
        number("pred_start_doy").alias("pred_start_doy"), number("pred_end_doy").alias("pred_end_doy"),
        count.alias("num_observations"), mae.alias("model_test_mae_days"),
    )
    checked = with_violation(rows)
    bad = checked.filter(F.col("violation").isNotNull())
    if strict:
        first = bad.first()
        if first is not None:
            raise ValueError(f"{first['violation']}: {first.asDict()}")
    return checked.filter(F.col("violation").isNull()).select(*C.PREDICTION_COLUMNS), bad


def read_tile_bounds(spark: SparkSession, path: str, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tiles with bounds, violations) from an artifact document; both are empty when the key is absent.

    ``rows`` reads the form with one JSON row per tile instead of one document.
    """
    docs = spark.read.schema(schemas.ARTIFACT_METADATA).option("multiLine", not rows).json(path)
    pairs = docs.select(F.explode("tile_bounds_wgs84").alias("tile", "b"))
    at = lambda k: F.try_element_at("b", F.lit(k))
    pairs = pairs.select("tile", F.size("b").alias("_n"), *[at(k).alias(c) for k, c in enumerate(
        ("lon_min", "lat_min", "lon_max", "lat_max"), 1)])
    fine = (F.col("_n") == 4) & (F.col("lon_min") < F.col("lon_max")) & (F.col("lat_min") < F.col("lat_max"))
    pairs = pairs.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    return pairs.filter("_ok").drop("_n", "_ok"), pairs.filter("not _ok").drop("_n", "_ok")


def read_scene_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Scenes from ``*_metadata.json`` documents; unreadable documents and bad polygons are left out."""
    schema = schemas.SCENE_DOCUMENT + ", _corrupt string"
    docs = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(glob)
        .select("*", F.col("_metadata.file_path").alias("metadata_path"))
    )
    return scenes_from_documents(docs.filter(F.col("_corrupt").isNull()).drop("_corrupt"))


def scenes_from_documents(docs: DataFrame) -> DataFrame:
    """The manifest rules on rows that carry the document columns and ``metadata_path``."""
    stem = F.regexp_replace(F.regexp_extract("metadata_path", r"([^/]+)$", 1), r"_metadata\.json$|\.json$", "")
    outer = F.try_element_at("geometry.coordinates", F.lit(1))
    whole = F.forall(outer, lambda p: F.coalesce((F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))
    good = (F.col("geometry.type") == "Polygon") & (F.size(outer) >= 4) & whole
    ring = F.transform(outer, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    acquired = F.trim(F.coalesce("properties.acquired", F.lit("")))
    rows = docs.filter(good).select(
        F.trim(F.coalesce(F.nullif(F.col("id"), F.lit("")), stem)).alias("id"), acquired.alias("acquired"),
        F.when(F.length(acquired) >= 10, F.try_to_date(F.substring(acquired, 1, 10), "yyyy-MM-dd")).alias("acquired_day"),
        ring.alias("ring"), "metadata_path",
    )
    return rows.withColumn("_e", ring_envelope(F.col("ring"))).select(*rows.columns, "_e.*")


def scenes_with_raster(scenes: DataFrame, files: DataFrame, suffix: str = "_3B_AnalyticMS_SR_8b_clip.tif") -> DataFrame:
    """Scenes whose raster file exists; adds its path."""
    named = files.select(F.col("path").alias("raster_path")).withColumn(
        "id", F.regexp_extract("raster_path", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    )
    return scenes.join(named.filter(F.col("id") != ""), "id")


def read_sidecars(spark: SparkSession, root: str, glob: str = "*.json", dateless: str = r"/(\d+_\d+)\.meta\.json$") -> DataFrame:
    """(tile, date) from the sidecar documents of outputs whose own name holds no date.

    Only documents whose path matches ``dateless`` are wanted: the condition is on the path alone, so the others are left
    out before they are opened. A document without ``meta_patch`` counts for the tile that the pattern's group finds in
    its path; unreadable ones and those without a real date are left out.
    """
    schema = "meta_patch string, date string, _corrupt string"
    docs = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").json(root)
    )
    path = F.col("_metadata.file_path")
    docs = docs.filter(path.rlike(dateless)).select("*", F.nullif(F.regexp_extract(path, dateless, 1), F.lit("")).alias("_tile"))
    rows = docs.filter(F.col("_corrupt").isNull()).select(F.coalesce(blank_to_null(F.col("meta_patch")), "_tile").alias("tile"), parse_date(F.col("date")).alias("date"))
    return rows.filter(F.col("tile").isNotNull() & F.col("date").isNotNull())


def read_season_summary(spark: SparkSession, path: str) -> DataFrame:
    """Typed season summary rows from the CSV twins; old header names are accepted, empty cells are null."""
    raw = spark.read.option("header", True).csv(path)
    return typed_season_summary(raw)


def typed_season_summary(raw: DataFrame) -> DataFrame:
    for old, new in (("div_result_start", "div_start"), ("div_result_end", "div_end")):
        if new not in raw.columns and old in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    text = lambda c: blank_to_null(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    numbers = {"NDVI", "NDWI", "EVI", "div_start", "div_end", "IoU", "seeding_offset_days"}
    extra = ["FarmID"] if "FarmID" in raw.columns else []
    out = []
    for c in (*extra, *C.SEASON_SUMMARY_COLUMNS):
        if c == "Date":
            out.append(parse_date(text(c)).alias(c))
        elif c in numbers:
            out.append(to_double_lenient(text(c)).alias(c))
        else:
            out.append(text(c).alias(c))
    keep = [c for c in ("year", "tile") if c in raw.columns]
    return raw.select(*keep, *out)


def read_model_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Per model document: crop folder, test error rounded to one decimal, and the years used."""
    docs = spark.read.schema(schemas.MODEL_METRICS).option("multiLine", True).json(glob)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return docs.select(
        F.coalesce("crop", F.url_decode(folder)).alias("crop"), "feature_set",
        F.round("test_metrics.mae_mean", 1).alias("test_mae_days"), "train_years", "test_years",
    )


def read_jobs(spark: SparkSession, glob: str) -> DataFrame:
    """Job documents; unreadable ones are dropped."""
    schema = schemas.JOBS + ", _corrupt string"
    docs = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(glob)
    return docs.filter(F.col("_corrupt").isNull() & F.col("job_id").isNotNull()).drop("_corrupt")
