"""Plans that write files as other programs leave them and read them back: artifacts, manifests, metrics, pixels, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide import constants as C
from fieldtide.functions import dates as D, indices as X, text as T
from fieldtide.operators import features, harvest, spatial
from fieldtide.plans import relations as R
from fieldtide.plans.operation_plans import _folder
from fieldtide.plans import harvest_plans, season_plans  # noqa: F401 (their SQL is used below)
from fieldtide.plans.registry import SQL, day, num, plan, r6


# ---------------------------------------------------------------- artifacts

@plan("artifact_round_trip", R.sql("predictions tiles", """
, held AS (SELECT p.* FROM predictions p JOIN tiles t USING (tile))
SELECT p.year, p.tile, p.crop, pred_start_doy, pred_end_doy, coalesce(num_observations, -1)::BIGINT AS num_observations,
  round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max, d.n AS prediction_row_count, d.tiles AS tile_count
FROM held p JOIN tiles t USING (tile) JOIN (SELECT year, count(*) AS n, count(DISTINCT tile) AS tiles FROM held GROUP BY year) d ON d.year = p.year"""))
def artifact_round_trip(spark, sf):
    """Two versions are published and a third fails its check; a reader sees the second."""
    from fieldtide.sources import artifacts
    from fieldtide.sources.files import artifact_path

    tiles, path = R.tiles(spark, sf), artifact_path(_folder(spark), 2024, "monthly", "all_indices", "artifact")
    predicted = _folder(spark) + "/predicted"
    R.predictions(spark, sf).join(tiles.select("tile"), "tile", "left_semi").write.parquet(predicted)
    p = spark.read.parquet(predicted)  # six passes over reduced rows instead of over the readings
    years = R.crops(spark).select("crop", F.array(F.lit(2019)).alias("train_years"), F.array(F.lit(2020)).alias("test_years"))
    document = lambda rows: harvest.artifact_metadata(rows, rows, tiles, years)
    first = p.filter("crop = 'Corn'")
    artifacts.publish_artifact(first, document(first), tiles, path)
    artifacts.publish_artifact(p, document(p), tiles, path)
    try:
        artifacts.publish_artifact(first, document(p), tiles, path)
    except ValueError:
        pass  # its document counts other rows; nothing is committed
    rows, doc, bounds = artifacts.read_artifact(spark, path)
    out = rows.join(bounds, "tile").join(doc.select(F.col("year").cast("int").alias("year"), "prediction_row_count", "tile_count"), "year")
    return out.select("year", "tile", "crop", "pred_start_doy", "pred_end_doy", num("num_observations").alias("num_observations"),
                      r6("lon_min").alias("lon_min"), r6("lat_max").alias("lat_max"), "prediction_row_count", "tile_count")


@plan("harvest_report_round_trip", SQL["harvest_report"])
def harvest_report_round_trip(spark, sf):
    """The report as a CSV file, read back."""
    from fieldtide.plans.harvest_plans import harvest_by_crop
    from fieldtide.sources.sinks import write_harvest_report

    path = _folder(spark) + "/report"
    write_harvest_report(harvest_by_crop(spark, sf), path)
    out = spark.read.option("header", True).csv(path)
    whole = {"Start DOY": "int", "End DOY": "int", "Tiles": "bigint", "Test MAE (days)": "double"}
    return out.select(*[F.col(f"`{c}`").cast(whole.get(c, "string")).alias(c) for c in out.columns])


@plan("farm_summary_round_trip", SQL["farm_summary_rows"])
def farm_summary_round_trip(spark, sf):
    """Summaries of all years as CSV files, read back; empty cells come back empty."""
    from fieldtide.operators import observations as O
    from fieldtide.plans.season_plans import _timeline
    from fieldtide.sources.sinks import write_farm_summary

    # The order of the key is that of the timeline's rows, which are not sorted again.
    key, path = ("year", "farm_id", "crop"), _folder(spark) + "/farms"
    write_farm_summary(O.farm_season_summary(O.row_numbers(_timeline(spark, sf).withColumn("farm_id", F.col("tile")), key), key), path)
    out = spark.read.option("header", True).csv(path)
    return out.select(F.col("year").cast("int").alias("year"), *[F.coalesce(c, F.lit("")).alias(c) for c in C.FARM_SUMMARY_COLUMNS])


@plan("build_records_all", R.sql("flagged windows labelled", """
, inside AS (SELECT year, tile, crop, date, round(ndvi, 4) AS ndvi, round(ndwi, 4) AS ndwi, round(evi, 4) AS evi FROM flagged LEFT JOIN windows USING (crop)
  WHERE start_md IS NULL OR month(date) * 100 + day(date) BETWEEN replace(start_md, '-', '')::INT AND replace(end_md, '-', '')::INT),
r AS (SELECT year, tile, crop, any_value(start_doy) AS start_doy, any_value(end_doy) AS end_doy, count(coalesce(ndvi, ndwi, evi)) AS n
  FROM inside JOIN labelled USING (year, tile, crop) GROUP BY ALL
  HAVING n >= 2 AND any_value(start_doy) IS NOT NULL AND any_value(end_doy) IS NOT NULL AND any_value(start_doy) <= any_value(end_doy)),
b AS (SELECT year, tile, crop, least((dayofyear(date) - 1) // 5, 72)::INT AS bin, avg(ndvi) AS ndvi, avg(ndwi) AS ndwi, avg(evi) AS evi FROM inside GROUP BY ALL),
long AS (SELECT year, tile, crop, bin, 0 AS channel, ndvi::FLOAT::DOUBLE AS v FROM b WHERE ndvi IS NOT NULL UNION ALL SELECT year, tile, crop, bin, 1, ndwi::FLOAT::DOUBLE FROM b WHERE ndwi IS NOT NULL
  UNION ALL SELECT year, tile, crop, bin, 2, evi::FLOAT::DOUBLE FROM b WHERE evi IS NOT NULL),
grid AS (SELECT r.*, channel, x.bin::INT AS bin FROM r, range(3) c(channel), range(73) x(bin))
SELECT g.year, g.tile, g.crop, g.start_doy::INT AS start_doy, g.end_doy::INT AS end_doy, g.n::INT AS num_observations, g.channel::INT AS channel, g.bin,
  round((CASE WHEN o.v IS NOT NULL THEN o.v WHEN l.bin IS NULL OR n.bin IS NULL THEN 0 ELSE (n.v - l.v) / (n.bin - l.bin) * (g.bin - l.bin) + l.v END::FLOAT)::DOUBLE, 6) AS value
FROM grid g LEFT JOIN long o ON g.year = o.year AND g.tile = o.tile AND g.crop = o.crop AND g.channel = o.channel AND g.bin = o.bin
ASOF LEFT JOIN long l ON g.year = l.year AND g.tile = l.tile AND g.crop = l.crop AND g.channel = l.channel AND g.bin >= l.bin
ASOF LEFT JOIN long n ON g.year = n.year AND g.tile = n.tile AND g.crop = n.crop AND g.channel = n.channel AND g.bin <= n.bin
UNION ALL
SELECT r.year, r.tile, r.crop, r.start_doy::INT, r.end_doy::INT, r.n::INT, 3, x.bin::INT,
  round(coalesce(((b.ndvi IS NOT NULL)::INT + (b.ndwi IS NOT NULL)::INT + (b.evi IS NOT NULL)::INT) / 3::DOUBLE, 0)::FLOAT::DOUBLE, 6)
FROM r JOIN range(73) x(bin) ON true LEFT JOIN b ON b.year = r.year AND b.tile = r.tile AND b.crop = r.crop AND b.bin = x.bin"""))
def build_records_all(spark, sf):
    """Records of all three indices and the share of them that a bin has."""
    from fieldtide.plans.season_plans import _flagged

    out = features.build_records(_flagged(spark, sf), "all_indices", R.windows(spark), round4=True)
    rows = out.select(*R.SERIES, "start_doy", "end_doy", "num_observations", F.posexplode("x").alias("channel", "_v"))
    rows = rows.select(*R.SERIES, "start_doy", "end_doy", "num_observations", "channel", F.posexplode("_v").alias("bin", "_x"))
    return rows.select(*R.SERIES, "start_doy", "end_doy", "num_observations", "channel", "bin", r6("_x").alias("value"))


@plan("model_metrics", """
SELECT p_type AS crop, 'all_indices' AS feature_set, round(avg(round(p_retailprice * 100)::BIGINT) / 100::DOUBLE, 1) AS test_mae_days, '2019' AS train_years, '2020,2021' AS test_years
FROM part GROUP BY p_type""")
def model_metrics(spark, sf):
    """A metrics document per folder; names come from the folder where the document has none."""
    from fieldtide.sources.tables import read_model_metrics

    mae = F.avg(F.floor(F.col("p_retailprice") * 100 + 0.5)) / 100
    g = R.table(spark, sf, "part").groupBy("p_type").agg(mae.alias("mae"))
    doc = F.to_json(F.struct(
        F.when(F.length("p_type") % 2 == 0, F.col("p_type")).alias("crop"), F.lit("all_indices").alias("feature_set"),
        F.array(F.lit(2019)).alias("train_years"), F.array(F.lit(2020), F.lit(2021)).alias("test_years"),
        F.struct(F.col("mae").alias("mae_mean")).alias("test_metrics")))
    path = _folder(spark) + "/models"
    g.select("p_type", doc.alias("value")).repartition("p_type").write.partitionBy("p_type").text(path)
    out = read_model_metrics(spark, path + "/*/*.txt")
    years = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    # The folder that Spark writes is named column=value.
    return out.select(F.regexp_replace("crop", "^p_type=", "").alias("crop"), "feature_set", "test_mae_days", years("train_years"), years("test_years"))


# ---------------------------------------------------------------- scenes

@plan("scenes_with_raster", R.sql("tiles", """
, k AS (SELECT *, split_part(tile, '_', 1)::INT AS i, split_part(tile, '_', 2)::INT AS j FROM tiles)
SELECT 'scene' || tile AS id, '2024-08-13' AS acquired_day, round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max,
  '/rasters/scene' || tile || '_3B_AnalyticMS_SR_8b_clip.tif' AS raster_path FROM k WHERE j % 4 <> 2 AND i % 3 <> 1"""))
def scenes_with_raster(spark, sf):
    """Manifests as JSON files, an array of scenes each, of which every fourth is cut off; two of three scenes have a raster."""
    from fieldtide.sources.tables import read_scene_manifest, scenes_with_raster as with_raster

    t = R.tiles(spark, sf)
    i, j = T.tile_i(F.col("tile")), T.tile_j(F.col("tile"))
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (
        ("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min"))])
    scene = F.concat(F.lit("scene"), F.col("tile"))
    doc = F.struct(scene.alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
                   F.struct(F.lit("2024-08-13T17:01:02Z").alias("acquired")).alias("properties"))
    files = t.groupBy(j.alias("strip")).agg(F.to_json(F.collect_list(doc)).alias("value"))
    cut = F.expr("substring(value, 1, length(value) - 40)")
    path = _folder(spark) + "/manifests"
    files.select("strip", F.when(F.col("strip") % 4 == 2, cut).otherwise(F.col("value")).alias("value")).write.partitionBy("strip").text(path)
    rasters = t.filter(i % 3 != 1).select(F.concat(F.lit("/rasters/"), scene, F.lit("_3B_AnalyticMS_SR_8b_clip.tif")).alias("path"))
    out = with_raster(read_scene_manifest(spark, path + "/*/*.txt"), rasters)
    return out.select("id", day("acquired_day").alias("acquired_day"), r6("lon_min").alias("lon_min"), r6("lat_max").alias("lat_max"), "raster_path")


@plan("list_files", "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, 'txt' AS ending, 1 AS filled FROM orders")
def list_files(spark, sf):
    """Folders of a tree that Spark wrote, by its listing; files of other endings are left out."""
    from fieldtide.sources.files import list_files as listing

    path = _folder(spark) + "/tree"
    R.table(spark, sf, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("o_orderstatus").text(path)
    files = listing(spark, path, "*.txt")
    out = files.groupBy(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"[.]([a-z]+)$", 1).alias("ending"))
    return out.agg((F.sum("length") > 0).cast("int").alias("filled"))


# ---------------------------------------------------------------- pixels

@plan("pixels_round_trip", R.sql("px", """
, lacking AS (SELECT DISTINCT tile, date FROM px WHERE (split_part(tile, '_', 1)::INT + day(date)) % 3 = 0)
SELECT tile, date::VARCHAR AS date, row, col, B4, B11 FROM px WHERE (tile, date) NOT IN (SELECT tile, date FROM lacking)"""))
def pixels_round_trip(spark, sf):
    """Some images are written without a band and skipped by the reader."""
    from fieldtide.sources.pixels import read_pixels, write_pixels

    path = _folder(spark) + "/pixels"
    px = R.pixels(spark, sf, ("B4", "B11"))
    lacks = (T.tile_i(F.col("tile")) + F.dayofmonth("date")) % 3 == 0
    write_pixels(px.withColumn("B11", F.when(~lacks, F.col("B11"))), path)
    out = read_pixels(spark, path, ["B4", "B11"])
    return out.select("tile", day("date").alias("date"), "row", "col", "B4", "B11")


_SWIR = "coalesce(CASE WHEN col % 3 <> 0 THEN B11 END, B8 // 2) / 10000::DOUBLE"


@plan("all_indices", R.sql("px", f"""
, v AS (SELECT tile, date, row, col, B2 / 10000::DOUBLE AS b, B4 / 10000::DOUBLE AS r, B8 / 10000::DOUBLE AS n, {_SWIR} AS s FROM px)
SELECT tile, date::VARCHAR AS date, row, col, round(greatest(least((n - r) / (n + r + 1e-10), 1), -1), 6) AS ndvi,
  round(greatest(least((n - s) / (n + s + 1e-10), 1), -1), 6) AS ndwi,
  round(greatest(least(2.5::DOUBLE * (n - r) / (n + 6 * r - 7.5::DOUBLE * b + 1 + 1e-10::DOUBLE), 1), -1), 6) AS evi FROM v"""))
def all_indices(spark, sf):
    """All three indices of a pixel; where the first short-wave band is missing, the second stands in."""
    b11 = F.when(F.col("col") % 3 != 0, F.col("B11"))
    swir = X.swir_band(b11, F.floor(F.col("B8") / 2).cast("int"))
    found = X.all_indices(X.reflectance(F.col("B8")), X.reflectance(F.col("B4")), X.reflectance(F.col("B2")), X.reflectance(swir))
    out = R.pixels(spark, sf).withColumn("_i", found)
    return out.select("tile", day("date").alias("date"), "row", "col", *[r6(f"_i.{c}").alias(c) for c in ("ndvi", "ndwi", "evi")])


# ---------------------------------------------------------------- grids, months, order

@plan("make_grid", f"""
SELECT i || '_' || j AS tile, {R.cell_bounds_sql('i', 'j')} FROM range({C.GRID_N}) a(i), range({C.GRID_N}) b(j)
WHERE EXISTS (SELECT 1 FROM supplier s WHERE (s.s_suppkey % 20) = i)""")
def make_grid(spark, sf):
    """Cells of the region's grid in the columns that have a supplier."""
    held = R.table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).cast("int").alias("i")).distinct()
    return spatial.make_grid(spark).join(held, "i", "left_semi").select("tile", *spatial.BOUNDS)


@plan("choose_model_month", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_orderkey % 3 <> 0 THEN greatest(least(month(o_orderdate), {C.MODEL_MONTH_MAX}), {C.MODEL_MONTH_MIN})
  ELSE 8 END::INT AS month FROM orders""")
def choose_model_month(spark, sf):
    """An asked month, else the month of the data in the models' range, else the newest there is."""
    k = F.col("o_orderkey")
    month = F.when(k % 3 != 0, F.month("o_orderdate"))
    out = D.choose_model_month(F.when(k % 5 == 0, F.lit(9)), month, F.lit(8))
    return R.table(spark, sf, "orders").select("o_orderkey", out.cast("int").alias("month"))


@plan("sort_records", R.sql("predictions", """
SELECT year, tile, crop, row_number() OVER (PARTITION BY crop, year ORDER BY tile) AS place FROM predictions"""))
def sort_records(spark, sf):
    """The order of written records: places are taken from the sorted files as they are read back."""
    path = _folder(spark) + "/sorted"
    features.sort_records(R.predictions(spark, sf).select("year", "tile", "crop")).write.parquet(path)
    read = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    from pyspark.sql import Window as W

    w = W.partitionBy("crop", "year").orderBy("_file", "_row")
    return read.select("year", "tile", "crop", F.row_number().over(w).cast("bigint").alias("place"))
