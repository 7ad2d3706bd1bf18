"""Harvest windows for boxes, tile selection and artifact checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide import constants as C
from fieldtide.functions import dates as D, geometry as G
from fieldtide.operators import harvest, spatial, stats
from fieldtide.plans import relations as R
from fieldtide.plans.registry import bit, day, num, plan, r6


def _pct_sql(col: str, q: int) -> str:
    """Integer percentile of a sorted list column, half to even."""
    n = f"len({col})"
    t = f"({q} * ({n} - 1))"
    lo, hi = f"{col}[{t} // 100 + 1]", f"{col}[least({t} // 100 + 2, {n})]"
    s = f"({lo} * (100 - {t} % 100) + {hi} * ({t} % 100))"
    return (
        f"({s} // 100 + CASE WHEN {s} % 100 > 50 OR ({s} % 100 = 50 AND ({s} // 100) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def _date_sql(year: str, d: str) -> str:
    length = f"dayofyear(make_date({year}, 12, 31))"
    return f"(make_date({year}, 1, 1) + (greatest(least({d}, {length}), 1) - 1)::INT)::DATE::VARCHAR"


HARVEST_SQL = R.sql("predictions pairs", f"""
, joined AS (SELECT p.*, x.request_id FROM predictions p JOIN pairs x USING (year, tile)),
lists AS (SELECT request_id, year, crop, list(pred_start_doy::BIGINT ORDER BY pred_start_doy) AS s,
    list(pred_end_doy::BIGINT ORDER BY pred_end_doy) AS e,
    list(num_observations::BIGINT ORDER BY num_observations) FILTER (WHERE num_observations IS NOT NULL) AS o, count(*) AS n,
    (list(model_test_mae_days ORDER BY tile) FILTER (WHERE model_test_mae_days IS NOT NULL))[1] AS mae
  FROM joined GROUP BY ALL),
p AS (SELECT request_id, year, crop, n, mae, {_pct_sql('s', 10)} AS s10, {_pct_sql('s', 50)} AS s50, {_pct_sql('s', 90)} AS s90,
  {_pct_sql('e', 10)} AS e10, {_pct_sql('e', 50)} AS e50, {_pct_sql('e', 90)} AS e90, {_pct_sql('o', 50)} AS o50 FROM lists)
SELECT request_id, year, crop, s50 AS start_doy, greatest(s50, e50) AS end_doy,
  {_date_sql('year', 's50')} AS harvest_start_date, {_date_sql('year', 'greatest(s50, e50)')} AS harvest_end_date,
  {_date_sql('year', 's10')} AS start_date_p10, {_date_sql('year', 's90')} AS start_date_p90,
  {_date_sql('year', 'e10')} AS end_date_p10, {_date_sql('year', 'e90')} AS end_date_p90,
  n AS tiles_with_crop, coalesce(o50, -1) AS median_observations_per_tile,
  coalesce(floor(mae * 10 + 0.5) / 10, -1)::DOUBLE AS model_test_mae_days FROM p""")


def _harvest(spark, sf):
    return harvest.harvest_by_crop(R.predictions(spark, sf), R.tiles(spark, sf), R.boxes(spark, sf))


@plan("harvest_by_crop", HARVEST_SQL)
def harvest_by_crop(spark, sf):
    out = _harvest(spark, sf)
    dates = [c for c in out.columns if "date" in c]
    return out.withColumns({
        **{c: day(c) for c in dates}, "median_observations_per_tile": num("median_observations_per_tile"),
        "model_test_mae_days": F.coalesce("model_test_mae_days", F.lit(-1.0)),
    })


@plan("harvest_report", "SELECT crop AS \"Crop\", harvest_start_date AS \"Harvest start\", harvest_end_date AS \"Harvest end\", "
      "start_doy AS \"Start DOY\", end_doy AS \"End DOY\", tiles_with_crop AS \"Tiles\", "
      "start_date_p10 || ' to ' || start_date_p90 AS \"Start range (P10-P90)\", "
      "end_date_p10 || ' to ' || end_date_p90 AS \"End range (P10-P90)\", "
      f"model_test_mae_days AS \"Test MAE (days)\" FROM ({HARVEST_SQL})")
def harvest_report(spark, sf):
    return harvest.harvest_report(harvest_by_crop(spark, sf))


@plan("tiles_for_boxes", R.sql("pairs", "SELECT request_id, tile FROM pairs"))
def tiles_for_boxes(spark, sf):
    return spatial.tiles_intersecting(R.tiles(spark, sf), R.boxes(spark, sf))


@plan("grid_cells_for_boxes", R.sql("boxes", f"""
, cells AS (SELECT i, j, {R.cell_bounds_sql('i', 'j')} FROM range(20) a(i), range(20) b(j))
SELECT b.request_id, c.i || '_' || c.j AS tile FROM boxes b JOIN cells c
  ON c.lon_min <= b.lon_max AND c.lon_max >= b.lon_min AND c.lat_min <= b.lat_max AND c.lat_max >= b.lat_min"""))
def grid_cells_for_boxes(spark, sf):
    return spatial.grid_cells_for_bbox(R.boxes(spark, sf)).select("request_id", "tile")


@plan("missing_tiles", R.sql("pairs predictions", """
, p AS (SELECT year, tile, crop, pred_end_doy > 360 AS late FROM predictions)
SELECT request_id, x.year, tile, crop, late::INT AS late FROM pairs x JOIN (SELECT DISTINCT year, crop, late FROM p) c ON c.year = x.year
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.year = x.year AND p.tile = x.tile AND p.crop = c.crop AND p.late = c.late)"""))
def missing_tiles(spark, sf):
    """Tiles of a request that lack an early or a late season of a crop."""
    p = R.predictions(spark, sf).withColumn("late", F.col("pred_end_doy") > 360)
    return harvest.missing_tiles(p, R.tiles(spark, sf), R.boxes(spark, sf), by=("crop", "late")).withColumn("late", bit("late"))


@plan("predictions_for_tiles", R.sql("predictions pairs", """
SELECT year, tile, crop, pred_start_doy, pred_end_doy FROM predictions p
WHERE EXISTS (SELECT 1 FROM pairs x WHERE x.year = p.year AND x.tile = p.tile)"""))
def predictions_for_tiles(spark, sf):
    chosen = spatial.tiles_intersecting(R.tiles(spark, sf), R.boxes(spark, sf), box_cols=("year",))
    return harvest.predictions_for_tiles(R.predictions(spark, sf), chosen).select(
        "year", "tile", "crop", "pred_start_doy", "pred_end_doy")


@plan("region_envelope", R.sql("tiles", """
SELECT min(lon_min) AS lon_min, min(lat_min) AS lat_min, max(lon_max) AS lon_max, max(lat_max) AS lat_max FROM tiles"""))
def region_envelope(spark, sf):
    return spatial.envelope(R.tiles(spark, sf))


@plan("region_guard", R.sql("boxes", f"""
SELECT request_id, CASE WHEN lon_min >= lon_max OR lat_min >= lat_max THEN 'empty_box'
  WHEN lon_max < {R.lit(C.REGION['lon_min'])} OR lon_min > {R.lit(C.REGION['lon_max'])} OR lat_max < {R.lit(C.REGION['lat_min'])}
    OR lat_min > {R.lit(C.REGION['lat_max'])} THEN 'outside_region' ELSE '' END AS violation
FROM (SELECT request_id, lon_min + request_id % 3 * 4 AS lon_min, CASE WHEN request_id % 6 = 0 THEN lon_min ELSE lon_max + request_id % 3 * 4 END AS lon_max,
  lat_min, lat_max FROM boxes)"""))
def region_guard(spark, sf):
    k = F.col("request_id")
    moved = R.boxes(spark, sf).select(
        "request_id", (F.col("lon_min") + k % 3 * 4).alias("lon_min"),
        F.when(k % 6 == 0, F.col("lon_min")).otherwise(F.col("lon_max") + k % 3 * 4).alias("lon_max"), "lat_min", "lat_max",
    )
    return spatial.region_guard(moved).select("request_id", F.coalesce("violation", F.lit("")).alias("violation"))


@plan("subregions", R.sql("tiles", """
SELECT tile, i || '_' || j AS part,
  round(lon_min + i * ((lon_max - lon_min) / 3), 6) AS lon_min, round(lat_min + j * ((lat_max - lat_min) / 3), 6) AS lat_min,
  round(CASE WHEN i = 2 THEN lon_max ELSE lon_min + (i + 1) * ((lon_max - lon_min) / 3) END, 6) AS lon_max,
  round(CASE WHEN j = 2 THEN lat_max ELSE lat_min + (j + 1) * ((lat_max - lat_min) / 3) END, 6) AS lat_max
FROM tiles, range(3) a(i), range(3) b(j)"""))
def subregions(spark, sf):
    out = spatial.subregions(R.tiles(spark, sf), 3)
    return out.select("tile", "part", *[r6(c).alias(c) for c in spatial.BOUNDS])


@plan("adaptive_grid", R.sql("boxes", """
SELECT request_id, greatest(least(ceil((lon_max - lon_min) / 0.2::DOUBLE), 12), 1)::INT AS grid_cols,
  greatest(least(ceil((lat_max - lat_min) / 0.15::DOUBLE), 12), 1)::INT AS grid_rows FROM boxes"""))
def adaptive_grid(spark, sf):
    size = spatial.adaptive_grid_size(*[F.col(b) for b in spatial.BOUNDS], 0.2, 0.15, 12)
    return R.boxes(spark, sf).select("request_id", F.inline(F.array(size)))


_LAYOUT_SQL = R.sql("tiles", """
, wanted AS (SELECT tile AS folder, CASE WHEN hash_key % 4 = 0 THEN 10 ELSE 20 END AS grid_cols, 20 AS grid_rows, lon_min, lat_min, lon_max, lat_max, hash_key
  FROM (SELECT *, split_part(tile, '_', 1)::INT + split_part(tile, '_', 2)::INT AS hash_key FROM tiles)),
old AS (SELECT folder, 20 AS c, 20 AS r, CASE WHEN hash_key % 5 = 0 THEN lon_min + 0.5::DOUBLE ELSE lon_min END AS lon_min FROM wanted WHERE hash_key % 3 = 0)
SELECT w.folder, CASE WHEN o.folder IS NOT NULL AND NOT (o.c = w.grid_cols AND o.r = w.grid_rows AND o.lon_min = w.lon_min) THEN 'layout_mismatch'
  WHEN o.folder IS NULL AND w.hash_key % 2 = 0 AND (w.grid_cols <> 20 OR w.grid_rows <> 20) THEN 'unlabelled_tiles' ELSE '' END AS violation,
  CASE WHEN o.folder IS NOT NULL THEN 'first' ELSE 'now' END AS created_at
FROM wanted w LEFT JOIN old o USING (folder)""")


@plan("grid_layout_check", _LAYOUT_SQL)
def grid_layout_check(spark, sf):
    from fieldtide.functions.text import tile_i, tile_j

    k = tile_i(F.col("tile")) + tile_j(F.col("tile"))
    wanted = R.tiles(spark, sf).select(
        F.col("tile").alias("folder"), k.alias("k"), F.when(k % 4 == 0, 10).otherwise(20).alias("grid_cols"),
        F.lit(20).alias("grid_rows"), *spatial.BOUNDS)
    old = wanted.filter("k % 3 = 0").withColumns({
        "grid_cols": F.lit(20), "created_at": F.lit("first"),
        "lon_min": F.when(F.col("k") % 5 == 0, F.col("lon_min") + 0.5).otherwise(F.col("lon_min"))})
    bare = wanted.filter("k % 2 = 0").select("folder")
    out = spatial.grid_layout_check(wanted, old, bare, F.lit("now"))
    return out.select("folder", F.coalesce("violation", F.lit("")).alias("violation"), "created_at")


@plan("artifact_metadata", R.sql("predictions tiles", """
SELECT year, count(*)::BIGINT AS prediction_row_count, count(DISTINCT crop) AS crop_count, count(DISTINCT p.tile) AS tile_count,
  array_to_string(list_sort(list(DISTINCT crop)), ',') AS crops,
  CASE WHEN count(*) FILTER (WHERE crop = 'Rice') > 0 THEN '1995,1996,1997' ELSE '1995,1996' END AS trained_years,
  CASE WHEN count(*) FILTER (WHERE crop IN ('Corn', 'Rice')) > 0 THEN '1998' ELSE '' END AS evaluated_years,
  count(*) FILTER (WHERE num_observations IS NOT NULL) AS input_record_count,
  round(min(lon_min), 6) AS lon_min, round(min(lat_min), 6) AS lat_min, round(max(lon_max), 6) AS lon_max, round(max(lat_max), 6) AS lat_max,
  'The selected model was trained on ' || CASE WHEN count(*) FILTER (WHERE crop = 'Rice') > 0 THEN '1995, 1996, 1997' ELSE '1995, 1996' END
    || ' and evaluated on ' || CASE WHEN count(*) FILTER (WHERE crop IN ('Corn', 'Rice')) > 0 THEN '1998' ELSE '' END || '.' AS training_note
FROM predictions p JOIN tiles t USING (tile) GROUP BY year"""))
def artifact_metadata(spark, sf):
    p = R.predictions(spark, sf)
    years = spark.createDataFrame(
        [("Corn", [1995, 1996], [1998]), ("Rice", [1996, 1997], [1998]), ("Rye", [1995, 1996], [])],
        "crop string, train_years array<int>, test_years array<int>")
    doc = harvest.artifact_metadata(p, p.filter("num_observations is not null"), R.tiles(spark, sf), years)
    return doc.select(
        "year", "prediction_row_count", "crop_count", "tile_count", F.array_join("crops", ",").alias("crops"),
        F.array_join("trained_years", ",").alias("trained_years"), F.array_join("evaluated_years", ",").alias("evaluated_years"),
        "input_record_count", *[r6(f"supported_region.{c}").alias(c) for c in spatial.BOUNDS], "training_note")


@plan("artifact_bounds", R.sql("predictions tiles", """
SELECT DISTINCT year, p.tile, round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max FROM predictions p JOIN tiles USING (tile)"""))
def artifact_bounds(spark, sf):
    out = harvest.artifact_bounds(R.predictions(spark, sf), R.tiles(spark, sf))
    return out.select("year", "tile", r6("lon_min").alias("lon_min"), r6("lat_max").alias("lat_max"))


@plan("artifact_summary", R.sql("predictions tiles", """
, arts AS (SELECT DISTINCT year, p.tile, CASE WHEN year % 2 = 0 OR split_part(p.tile, '_', 1)::INT % 3 = 0 THEN lon_min END AS lon_min, lat_max FROM predictions p JOIN tiles USING (tile)),
yearly AS (SELECT year, count(lon_min) AS tile_count, min(lon_min) AS lon_min, count(lon_min) > 10 AS ready FROM arts GROUP BY year)
SELECT year, tile_count, round(coalesce(lon_min, 0), 6) AS lon_min, (tile_count > 0)::INT AS ready FROM yearly"""))
def artifact_summary(spark, sf):
    from fieldtide.functions.text import tile_i

    some = (F.col("year") % 2 == 0) | (tile_i(F.col("tile")) % 3 == 0)
    arts = R.predictions(spark, sf).select("year", "tile").distinct().join(R.tiles(spark, sf), "tile").withColumns({
        "model": F.lit("hybrid"), "lon_min": F.when(some, F.col("lon_min"))})
    per_year, _ = harvest.artifact_summary(arts)
    return per_year.select("year", "tile_count", r6(F.coalesce("lon_min", F.lit(0.0))).alias("lon_min"), bit("ready").alias("ready"))


_BROKEN = """
, broken AS (SELECT year, CASE WHEN pred_start_doy % 10 = 7 THEN '' ELSE tile END AS tile, crop,
    CASE WHEN pred_start_doy % 10 = 3 THEN 400 WHEN pred_start_doy % 10 = 4 THEN pred_end_doy + 1 ELSE pred_start_doy END AS pred_start_doy, pred_end_doy
  FROM predictions UNION ALL SELECT year, tile, crop, pred_start_doy, pred_end_doy FROM predictions WHERE pred_end_doy % 10 = 1)"""


@plan("prediction_violations", R.sql("predictions", _BROKEN + """
SELECT year, tile, crop, pred_start_doy, pred_end_doy, violation FROM (
  SELECT *, CASE WHEN tile = '' THEN 'blank_key' WHEN pred_start_doy NOT BETWEEN 1 AND 366 OR pred_end_doy NOT BETWEEN 1 AND 366 THEN 'invalid_doy'
    WHEN pred_start_doy > pred_end_doy THEN 'start_after_end' WHEN count(*) OVER (PARTITION BY year, tile, crop) > 1 THEN 'duplicate_key' END AS violation
  FROM broken) WHERE violation IS NOT NULL"""))
def prediction_violations(spark, sf):
    p = R.predictions(spark, sf)
    s = F.col("pred_start_doy")
    broken = p.withColumns({
        "tile": F.when(s % 10 == 7, "").otherwise(F.col("tile")),
        "pred_start_doy": F.when(s % 10 == 3, 400).when(s % 10 == 4, F.col("pred_end_doy") + 1).otherwise(s),
    }).unionByName(p.filter("pred_end_doy % 10 = 1"))
    return harvest.prediction_violations(broken).select("year", "tile", "crop", "pred_start_doy", "pred_end_doy", "violation")


@plan("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return spatial.duplicate_keys(R.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@plan("class_histogram", R.sql("mask", """
SELECT tile, string_agg(label || ':' || n, ',' ORDER BY label::VARCHAR) AS histogram FROM (
  SELECT tile, label, count(*) AS n FROM mask GROUP BY ALL) GROUP BY tile"""))
def class_histogram(spark, sf):
    out = stats.class_histogram(R.mask(spark, sf), ["tile"])
    entries = F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return out.select("tile", F.array_join(entries, ",").alias("histogram"))


@plan("percentile_int", f"""
WITH g AS (SELECT l_suppkey, list(l_quantity::BIGINT ORDER BY l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, len(v) AS n, {_pct_sql('v', 10)} AS p10, {_pct_sql('v', 50)} AS p50, {_pct_sql('v', 90)} AS p90 FROM g""")
def percentile_int(spark, sf):
    return stats.percentile_int(R.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", (10, 50, 90))


@plan("percentile_unbounded", f"""
WITH g AS (SELECT l_returnflag, l_linestatus, list(v ORDER BY v) AS v FROM (
  SELECT l_returnflag, l_linestatus, round(l_extendedprice * 100)::BIGINT AS v FROM lineitem) GROUP BY ALL)
SELECT l_returnflag, l_linestatus, len(v) AS n, {', '.join(f"{_pct_sql('v', q)} AS p{q}" for q in (0, 1, 25, 50, 99, 100))} FROM g""")
def percentile_unbounded(spark, sf):
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint")
    rows = R.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", cents.alias("cents"))
    return stats.percentile_int(rows, ["l_returnflag", "l_linestatus"], "cents", (0, 1, 25, 50, 99, 100))


@plan("doy_roundtrip", f"""
SELECT o_orderkey, dayofyear(o_orderdate)::INT AS doy, {_date_sql('year(o_orderdate)', 'dayofyear(o_orderdate)')} AS back,
  {_date_sql('(year(o_orderdate) + 1)', '366')} AS clamped, least((dayofyear(o_orderdate) - 1) // 5, 72)::INT AS bin,
  round(dayofyear(o_orderdate) / 366::DOUBLE, 6) AS scaled,
  dayofyear(last_day(o_orderdate::DATE))::INT AS month_last_doy, last_day(o_orderdate::DATE)::VARCHAR AS month_last,
  (date_trunc('month', o_orderdate::DATE) - INTERVAL 1 MONTH)::DATE::VARCHAR AS previous_month,
  strftime(o_orderdate, '%Y-%m') AS month_tag,
  (date_trunc('month', o_orderdate::DATE)::DATE + (least(31, day(last_day(o_orderdate::DATE))) - 1)::INT)::VARCHAR AS pseudo,
  greatest(least(month(o_orderdate), 11), 6)::INT AS model_month
FROM orders""")
def doy_roundtrip(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    d, y, m = F.dayofyear("d"), F.year("d"), F.month("d")
    return o.select(
        "o_orderkey", d.alias("doy"), day(D.doy_to_date(y, d)).alias("back"), day(D.doy_to_date(y + 1, F.lit(366))).alias("clamped"),
        D.doy_bin(d).alias("bin"), r6(D.encode_doy(d)).alias("scaled"), D.max_doy_for_month(y, m).alias("month_last_doy"),
        day(D.month_range(y, m)["last"]).alias("month_last"), day(D.previous_month(F.col("d"))["first"]).alias("previous_month"),
        D.month_tag(y, m).alias("month_tag"), day(D.pseudo_month_date(y, m, F.lit(31))).alias("pseudo"),
        D.clamp_model_month(m).alias("model_month"))


@plan("decode_doy", """
SELECT o_orderkey, s AS start_doy, greatest(s, e) AS end_doy FROM (SELECT o_orderkey,
  least(greatest(round_even((o_orderkey % 1000) / 999::DOUBLE * 366, 0), 1), 366)::INT AS s,
  least(greatest(round_even((o_custkey % 500) / 499::DOUBLE * 366, 0), 1), 366)::INT AS e FROM orders)""")
def decode_doy(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = D.decode_doy((F.col("o_orderkey") % 1000) / F.lit(999.0), (F.col("o_custkey") % 500) / F.lit(499.0))
    return o.select("o_orderkey", F.inline(F.array(out)))


@plan("split_by_month", """
SELECT o_orderkey, greatest(m::DATE, s)::VARCHAR AS part_start, least(last_day(m::DATE), e)::VARCHAR AS part_end
FROM (SELECT o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 90)::INT AS e FROM orders),
  LATERAL (SELECT unnest(generate_series(date_trunc('month', s)::TIMESTAMP, date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)""")
def split_by_month(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    o = o.withColumn("e", F.date_add("s", (F.col("o_orderkey") % 90).cast("int")))
    return o.select("o_orderkey", F.inline(D.split_by_month(F.col("s"), F.col("e")))).select(
        "o_orderkey", day("part_start").alias("part_start"), day("part_end").alias("part_end"))


@plan("month_day_filter", R.sql("obs windows", """
SELECT year, tile, crop, date::VARCHAR AS date FROM obs LEFT JOIN windows USING (crop)
WHERE CASE crop WHEN 'Rye' THEN month(date) * 100 + day(date) >= 1115 OR month(date) * 100 + day(date) <= 215
  ELSE month(date) * 100 + day(date) BETWEEN replace(start_md, '-', '')::INT AND replace(end_md, '-', '')::INT END"""))
def month_day_filter(spark, sf):
    obs = R.observations(spark, sf).join(R.windows(spark), "crop", "left")
    start, end = F.coalesce("start_md", F.lit("11-15")), F.coalesce("end_md", F.lit("02-15"))
    return obs.filter(D.in_month_day_window(F.col("date"), start, end)).select("year", "tile", "crop", day("date").alias("date"))


@plan("web_mercator", R.sql("tiles", f"""
SELECT tile, round({R.lit(G.EARTH_RADIUS)} * radians(lon_min), 3) AS x_min,
  round({R.lit(G.EARTH_RADIUS)} * ln(tan(pi() / 4 + radians(lat_min) / 2)), 3) AS y_min,
  round(lon_max, 6) AS lon_back, round(lat_max, 6) AS lat_back FROM tiles"""))
def web_mercator(spark, sf):
    t = R.tiles(spark, sf).withColumn("m", G.wgs84_to_mercator(*[F.col(b) for b in spatial.BOUNDS]))
    t = t.withColumn("b", G.mercator_to_wgs84(*[F.col(f"m.{c}") for c in ("x_min", "y_min", "x_max", "y_max")]))
    return t.select("tile", F.round("m.x_min", 3).alias("x_min"), F.round("m.y_min", 3).alias("y_min"),
                    r6("b.lon_max").alias("lon_back"), r6("b.lat_max").alias("lat_back"))


@plan("parse_bbox", R.sql("boxes", """
, t AS (SELECT request_id, CASE request_id % 6 WHEN 0 THEN '1,2,3' WHEN 1 THEN 'a,2,3,4' WHEN 2 THEN round(lon_max, 4) || ',' || round(lat_min, 4) || ',' || round(lon_min, 4) || ',' || round(lat_max, 4)
   WHEN 3 THEN '-190,1,2,3' ELSE round(lon_min, 4) || ', ' || round(lat_min, 4) || ',' || round(lon_max, 4) || ',' || round(lat_max, 4) END AS txt, lon_min FROM boxes)
SELECT request_id, CASE request_id % 6 WHEN 0 THEN 'four_numbers_required' WHEN 1 THEN 'not_a_number' WHEN 2 THEN 'longitude_range'
  WHEN 3 THEN 'longitude_limit' ELSE '' END AS violation,
  CASE WHEN request_id % 6 > 3 THEN round(lon_min, 4) ELSE 0 END AS lon_min FROM t"""))
def parse_bbox(spark, sf):
    k = F.col("request_id")
    four = lambda *c: F.concat_ws(",", *[F.round(F.col(x), 4).cast("string") for x in c])
    text = (F.when(k % 6 == 0, "1,2,3").when(k % 6 == 1, "a,2,3,4").when(k % 6 == 2, four("lon_max", "lat_min", "lon_min", "lat_max"))
            .when(k % 6 == 3, "-190,1,2,3").otherwise(four("lon_min", "lat_min", "lon_max", "lat_max")))
    b = R.boxes(spark, sf).withColumn("b", G.parse_bbox(text))
    return b.select("request_id", F.coalesce("b.violation", F.lit("")).alias("violation"),
                    F.when(k % 6 > 3, F.col("b.lon_min")).otherwise(0.0).alias("lon_min"))


@plan("pixel_windows", R.sql("headers boxes", """
, w AS (SELECT request_id, tile, round(greatest((b.lon_min - x0) / dx, 0), 6) AS l, round(least((b.lon_max - x0) / dx, 8), 6) AS r,
    round(greatest((b.lat_max - y0) / dy, 0), 6) AS t, round(least((b.lat_min - y0) / dy, 8), 6) AS m,
    round(least((b.lon_max - x0) / dx, 8) - greatest((b.lon_min - x0) / dx, 0), 6) AS wide, round(least((b.lat_min - y0) / dy, 8) - greatest((b.lat_max - y0) / dy, 0), 6) AS tall
  FROM headers h JOIN boxes b ON h.lon_min <= b.lon_max AND h.lon_max >= b.lon_min AND h.lat_min <= b.lat_max AND h.lat_max >= b.lat_min)
SELECT request_id, tile, floor(l)::BIGINT AS col_off, floor(t)::BIGINT AS row_off, ceil(wide)::BIGINT AS width, ceil(tall)::BIGINT AS height,
  (ceil(wide) > 0 AND ceil(tall) > 0)::INT AS valid FROM w"""))
def pixel_windows(spark, sf):
    h, b = R.headers(spark, sf), R.boxes(spark, sf)
    pairs = spatial.tiles_intersecting(h, b)
    rows = pairs.join(b.select("request_id", *[F.col(c).alias(f"b_{c}") for c in spatial.BOUNDS]), "request_id").join(h, "tile")
    win = G.window_for_bounds(*[F.col(f"b_{c}") for c in spatial.BOUNDS], *[F.col(c) for c in ("x0", "y0", "dx", "dy", "width", "height")])
    return rows.select("request_id", "tile", win.alias("w")).select("request_id", "tile", "w.col_off", "w.row_off", "w.width", "w.height", bit("w.valid").alias("valid"))


@plan("spectral_indices", R.sql("px", """
, v AS (SELECT vec_id, row, col, B2 / 10000::DOUBLE AS b, B4 / 10000::DOUBLE AS r, B8 / 10000::DOUBLE AS n, B11 / 10000::DOUBLE AS s FROM px)
SELECT vec_id, row, col, round(greatest(least((n - r) / (n + r + 1e-10), 1), -1), 6) AS ndvi,
  round(greatest(least((n - s) / (n + s + 1e-10), 1), -1), 6) AS ndwi,
  round(greatest(least(2.5::DOUBLE * (n - r) / (n + 6::DOUBLE * r - 7.5::DOUBLE * b + 1::DOUBLE + 1e-10), 1), -1), 6) AS evi FROM v"""))
def spectral_indices(spark, sf):
    from fieldtide.operators.observations import with_indices

    out = with_indices(R.pixels(spark, sf))
    return out.select("vec_id", "row", "col", *[r6(c).alias(c) for c in ("ndvi", "ndwi", "evi")])


@plan("evaluate_windows", R.sql("predictions", """
, j AS (SELECT a.crop, a.pred_start_doy AS s, a.pred_end_doy AS e, b.pred_start_doy AS ts, b.pred_end_doy AS te
  FROM predictions a JOIN predictions b ON a.year + 1 = b.year AND a.tile = b.tile AND a.crop = b.crop)
SELECT crop, count(*) AS records, round(avg(abs(s - ts)), 6) AS mae_start, round(avg(abs(e - te)), 6) AS mae_end,
  round((avg(abs(s - ts)) + avg(abs(e - te))) / 2, 6) AS mae_mean,
  round(avg(greatest(least(e, te) - greatest(s, ts), 0)::DOUBLE / nullif(greatest(e, te) - least(s, ts), 0)), 6) AS iou_mean,
  round(avg((s <= e)::INT), 6) AS ordered_pct FROM j GROUP BY crop"""))
def evaluate_windows(spark, sf):
    p = R.predictions(spark, sf)
    pred = p.select((F.col("year") + 1).alias("year"), "tile", "crop", F.col("pred_start_doy").alias("start_doy"), F.col("pred_end_doy").alias("end_doy"))
    truth = p.select("year", "tile", "crop", F.col("pred_start_doy").alias("start_doy"), F.col("pred_end_doy").alias("end_doy"))
    out = harvest.evaluate_windows(pred, truth)
    return out.select("crop", "records", *[r6(c).alias(c) for c in ("mae_start", "mae_end", "mae_mean", "iou_mean", "ordered_pct")])


@plan("limit_tiles", R.sql("tiles", """
SELECT tile, row_number() OVER (ORDER BY split_part(tile, '_', 1)::INT, split_part(tile, '_', 2)::INT) AS position FROM tiles
QUALIFY position <= 30"""))
def limit_tiles(spark, sf):
    from pyspark.sql import Window as W

    first = spatial.limit_tiles(R.tiles(spark, sf).select("tile"), 30)
    from fieldtide.functions.text import tile_i, tile_j
    w = W.orderBy(tile_i(F.col("tile")), tile_j(F.col("tile")))
    return first.select("tile", F.row_number().over(w).cast("bigint").alias("position"))


_TILE_I = "split_part(tile, '_', 1)::INT"
_SYSTEMS = f"""systems AS (SELECT tile, dx * (1 + {_TILE_I} % 5) AS dx, dy * (1 + {_TILE_I} % 4) AS dy,
  CASE WHEN {_TILE_I} % 7 = 6 THEN NULL WHEN {_TILE_I} % 7 = 5 THEN 'EPSG:32615' ELSE 'EPSG:4326' END AS crs FROM headers)"""


def _systems(spark, sf):
    """Headers of several resolutions and two reference systems, some without one."""
    from fieldtide.functions.text import tile_i

    i = tile_i(F.col("tile"))
    crs = F.when(i % 7 == 5, "EPSG:32615").when(i % 7 != 6, "EPSG:4326")
    return R.headers(spark, sf).withColumns({"dx": F.col("dx") * (1 + i % 5), "dy": F.col("dy") * (1 + i % 4), "crs": crs})


@plan("resolution_check", R.sql("headers", f"""
, {_SYSTEMS}
SELECT name, round(median(dx), 6) AS res_x, round(median(dy), 6) AS res_y, count(DISTINCT crs)::INT AS crs_count, count(crs) AS tiles,
  CASE count(DISTINCT crs) WHEN 0 THEN 'no_tiles' WHEN 1 THEN '' ELSE 'mixed_crs' END AS violation
FROM (SELECT unnest(['all', coalesce(crs, 'none')]) AS name, crs, CASE WHEN crs IS NOT NULL THEN dx END AS dx, CASE WHEN crs IS NOT NULL THEN dy END AS dy FROM systems)
GROUP BY name"""))
def resolution_check(spark, sf):
    tiles = _systems(spark, sf).withColumn("name", F.explode(F.array(F.lit("all"), F.coalesce("crs", F.lit("none")))))
    out = spatial.resolution_check(tiles, ["name"])
    return out.select("name", r6("res_x").alias("res_x"), r6("res_y").alias("res_y"), F.col("crs_count").cast("int").alias("crs_count"),
                      "tiles", F.coalesce("violation", F.lit("")).alias("violation"))


@plan("mosaic_size", R.sql("headers", f"""
, {_SYSTEMS}
SELECT {_TILE_I} % 4 AS part, ceil((max(lon_max) - min(lon_min)) / median(s.dx))::BIGINT AS width,
  ceil((max(lat_max) - min(lat_min)) / median(-s.dy))::BIGINT AS height, 0 AS large FROM headers JOIN systems s USING (tile) GROUP BY 1"""))
def mosaic_size(spark, sf):
    from fieldtide.functions.text import tile_i

    h = _systems(spark, sf).withColumn("part", tile_i(F.col("tile")) % 4)
    out = spatial.mosaic_size(h, F.col("dx"), -F.col("dy"), key=("part",))
    return out.select("part", "width", "height", bit("large").alias("large"))
