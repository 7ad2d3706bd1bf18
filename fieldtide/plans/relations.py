"""Season, tile and pixel tables derived from the sample warehouse tables, in Spark and in SQL.

Line items act as index readings of a tile (supplier), crop (return flag) and day; embeddings act as 8x8 image chips;
events act as acquisitions; nations act as request boxes. Values are built from integers, so that averages are exact
in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtide import constants as C
from fieldtide.functions.geometry import grid_edge
from fieldtide.functions.text import tile_name
from fieldtide.functions.series import savgol_length, savgol_weights
from fieldtide.sources import dimensions

WINDOWS = {"Corn": ["07-31", "10-15"], "Rice": {"start": "08-15", "end": "11-01"}}
LEGEND = {
    "num2class": {1: "Corn", 3: "Rice", 5: "Soybeans", 27: "Rye", 0: "Background"},
    "crop_type": {1: "Corn", 3: "Rice", 5: "Soybeans", 27: "Rye"},
}
STEP_LON = (C.REGION["lon_max"] - C.REGION["lon_min"]) / C.GRID_N
STEP_LAT = (C.REGION["lat_max"] - C.REGION["lat_min"]) / C.GRID_N
CHIP_RES = STEP_LON / 8
CHIP_RES_LAT = STEP_LAT / 8
PIXEL_BANDS = ("B2", "B3", "B4", "B8", "B11")

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def lit(x: float) -> str:
    """A double literal in SQL."""
    return f"{x!r}::DOUBLE"


def sql(needs: str, body: str) -> str:
    """``body`` preceded by the named common tables and everything they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs.split():
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head}\n{body}"


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- seasons

def _tile_of(key: Column) -> Column:
    return tile_name(key % 20, F.floor(key / 20).cast("bigint"))


def _crop_of(flag: Column) -> Column:
    return F.when(flag == "A", "Corn").when(flag == "N", "Rice").otherwise("Rye")


def _whole(name: str, scale: int = 100) -> Column:
    return F.floor(F.col(name) * scale + 0.5).cast("bigint")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.year("l_shipdate").alias("year"), _tile_of(F.col("l_suppkey")).alias("tile"),
        _crop_of(F.col("l_returnflag")).alias("crop"), F.to_date("l_shipdate").alias("date"),
        _whole("l_discount").alias("d"), _whole("l_tax").alias("t"), F.col("l_quantity").cast("bigint").alias("q"),
    )


cte("lines", "", """
SELECT year(l_shipdate)::INT AS year, (l_suppkey % 20)::VARCHAR || '_' || (l_suppkey // 20)::VARCHAR AS tile,
  CASE l_returnflag WHEN 'A' THEN 'Corn' WHEN 'N' THEN 'Rice' ELSE 'Rye' END AS crop, l_shipdate::DATE AS date,
  round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t, l_quantity::BIGINT AS q
FROM lineitem""")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per year, tile, crop and date, with some missing values. The rows are hashed by year, tile and crop."""
    from fieldtide.operators.seasons import by_series

    g = by_series(lines(spark, sf), SERIES).groupBy(*SERIES, "date").agg(
        F.sum("d").alias("d"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("c"))
    part = lambda v, scale, mod, gap: F.when(F.col(v) % mod != gap, F.col(v).cast("double") / (F.col("c") * scale).cast("double"))
    return g.select(
        "year", "tile", "crop", "date", part("d", 10, 11, 3).alias("ndvi"), part("t", 8, 13, 5).alias("ndwi"),
        part("q", 50, 17, 4).alias("evi"),
    )


cte("sums", "lines", """
SELECT year, tile, crop, date, sum(d)::BIGINT AS d, sum(t)::BIGINT AS t, sum(q)::BIGINT AS q, count(*) AS c
FROM lines GROUP BY ALL""")
cte("obs", "sums", """
SELECT year, tile, crop, date,
  CASE WHEN d % 11 <> 3 THEN d::DOUBLE / (c * 10)::DOUBLE END AS ndvi,
  CASE WHEN t % 13 <> 5 THEN t::DOUBLE / (c * 8)::DOUBLE END AS ndwi,
  CASE WHEN q % 17 <> 4 THEN q::DOUBLE / (c * 50)::DOUBLE END AS evi
FROM sums""")
cte("long", "obs", """
SELECT year, tile, crop, date, 'NDVI' AS index_name, ndvi AS y FROM obs
UNION ALL SELECT year, tile, crop, date, 'NDWI', ndwi FROM obs
UNION ALL SELECT year, tile, crop, date, 'EVI', evi FROM obs""")
K = "year, tile, crop, index_name"
SERIES = ["year", "tile", "crop"]
LONG_KEY = [*SERIES, "index_name"]
cte("pos", "long", f"""
SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY {K}) AS n, count(y) OVER (PARTITION BY {K}) AS n_valid FROM long""")
cte("neighbours", "pos", f"""
SELECT *,
  last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
  last_value(y IGNORE NULLS) OVER b AS py,
  first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni,
  first_value(y IGNORE NULLS) OVER a AS ny
FROM pos WINDOW
  b AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
cte("filled", "neighbours", f"""
SELECT {K}, date, y, i, n, n_valid,
  CASE WHEN y IS NOT NULL THEN y WHEN pi IS NULL THEN ny WHEN ni IS NULL THEN py
       ELSE (ny - py) / (ni - pi) * (i - pi) + py END AS filled
FROM neighbours""")


def _weight_rows() -> str:
    rows = []
    for w in (3, 5, 7, 9, 11):
        for e, line in enumerate(savgol_weights(w, C.SAVGOL_POLY)):
            rows += [f"({w},{e},{j},{v!r}::DOUBLE)" for j, v in enumerate(line)]
    return ", ".join(rows)


cte("weights", "", f"SELECT * FROM (VALUES {_weight_rows()}) AS v(win, e, j, wt)")
cte("lengths", "", "SELECT * FROM (VALUES " + ", ".join(
    f"({n},{savgol_length(n)})" for n in range(1, 12)) + ") AS v(len, win)")
cte("spans", "filled lengths", """
SELECT f.*, l.win, greatest(least(f.i - l.win // 2, f.n - l.win), 0) AS s0
FROM filled f JOIN lengths l ON l.len = least(f.n, 11)""")
cte("smoothed", "spans weights", f"""
SELECT a.year, a.tile, a.crop, a.index_name, a.date, a.i, a.n, a.n_valid, a.filled,
  CASE WHEN any_value(a.win) < 3 THEN round(any_value(a.filled), 9) ELSE round(sum(w.wt * b.filled), 9) END AS smooth
FROM spans a
LEFT JOIN weights w ON w.win = a.win AND w.e = a.i - a.s0
LEFT JOIN spans b ON b.year = a.year AND b.tile = a.tile AND b.crop = a.crop AND b.index_name = a.index_name
  AND b.i = a.s0 + w.j
GROUP BY ALL""")
cte("slopes", "smoothed", f"""
SELECT *, round(coalesce((lead(smooth) OVER w - lag(smooth) OVER w) / 2, lead(smooth) OVER w - smooth,
  smooth - lag(smooth) OVER w), 10) AS slope
FROM smoothed WINDOW w AS (PARTITION BY {K} ORDER BY date)""")
cte("peaks", "slopes", f"""
SELECT {K}, (list(i ORDER BY smooth DESC, i) FILTER (WHERE smooth IS NOT NULL))[1] AS peak_i, max(smooth) AS peak_y
FROM slopes GROUP BY ALL""")
cte("rows1", "slopes peaks", f"""
SELECT s.*, p.peak_i, p.peak_y, (p.peak_i <= 0 OR p.peak_i >= s.n - 1) AS boundary
FROM slopes s JOIN peaks p USING ({K})""")
cte("picks", "rows1", f"""
SELECT {K},
  coalesce((list(i ORDER BY slope, i) FILTER (WHERE i > peak_i AND slope IS NOT NULL))[1] - 1, any_value(peak_i)) AS start_i,
  (list(i ORDER BY smooth, i) FILTER (WHERE i >= peak_i AND smooth IS NOT NULL))[1] AS end_i
FROM rows1 GROUP BY ALL""")
cte("rows2", "rows1 picks", f"""
SELECT r.*, p.start_i, p.end_i,
  (NOT r.boundary AND p.start_i >= p.end_i AND p.start_i <> r.peak_i) AS retry,
  greatest(r.peak_i + 1, least(p.end_i, r.n - 1)) AS bound,
  (r.smooth <= 0.85::DOUBLE * r.peak_y)::INT
    + coalesce((lead(r.smooth, 1) OVER w <= 0.85::DOUBLE * r.peak_y)::INT, 0)
    + coalesce((lead(r.smooth, 2) OVER w <= 0.85::DOUBLE * r.peak_y)::INT, 0) AS low_run
FROM rows1 r JOIN picks p USING ({K}) WINDOW w AS (PARTITION BY {K} ORDER BY date)""")
cte("retries", "rows2", f"""
SELECT {K}, min(i) FILTER (WHERE retry AND i >= peak_i + 1 AND i + 2 < bound AND low_run = 3) AS run_i,
  (list(i ORDER BY slope, i) FILTER (WHERE retry AND i >= peak_i + 1 AND i < bound AND slope IS NOT NULL))[1] AS steep_i
FROM rows2 GROUP BY ALL""")
cte("rows3", "rows2 retries", f"""
SELECT r.*, t.run_i, t.steep_i, (r.n >= 3 AND r.n_valid >= 11) AS enough FROM rows2 r JOIN retries t USING ({K})""")
cte("rows4", "rows3", """
SELECT *,
  CASE WHEN enough AND NOT boundary THEN
    CASE WHEN retry THEN greatest(peak_i + 1, least(coalesce(run_i, steep_i, peak_i), end_i - 1)) ELSE start_i END END AS fin_s,
  CASE WHEN enough AND NOT boundary THEN end_i END AS fin_e,
  CASE WHEN NOT enough THEN 'insufficient_data' WHEN boundary THEN 'boundary_fallback'
    WHEN NOT retry THEN 'steepest_decline_after_peak' WHEN run_i IS NOT NULL THEN 'threshold_0.85_p3'
    WHEN steep_i IS NOT NULL THEN 'steepest_decline_after_peak_retry' ELSE 'no_derivative_after_peak_retry' END AS rule,
  CASE WHEN enough THEN smooth END AS usable
FROM rows3""")
cte("detected", "rows4", f"""
SELECT {K}, max(date) FILTER (WHERE i = fin_s) AS s_date, max(date) FILTER (WHERE i = fin_e) AS e_date,
  any_value(rule) AS rule, max(n) AS n, max(n_valid) AS n_valid, min(date) AS first_date, max(date) AS last_date
FROM rows4 GROUP BY ALL""")
cte("windows", "", "SELECT * FROM (VALUES ('Corn','07-31','10-15'), ('Rice','08-15','11-01')) AS v(crop, start_md, end_md)")
cte("seeding", "", "SELECT * FROM (VALUES ('Corn','03-15','04-30',10), ('Rice','03-20','04-30',14)) "
    "AS v(crop, window_start, window_end, offset_days)")
cte("rising", "rows4", f"""
SELECT {K}, date, i, n, usable,
  (lead(usable, 3) OVER w IS NOT NULL
   AND (coalesce(round(lead(usable, 1) OVER w - usable, 9) > 0.01, FALSE)::INT
      + coalesce(round(lead(usable, 2) OVER w - lead(usable, 1) OVER w, 9) > 0.01, FALSE)::INT
      + coalesce(round(lead(usable, 3) OVER w - lead(usable, 2) OVER w, 9) > 0.01, FALSE)::INT) >= 2
   AND round(lead(usable, 3) OVER w - usable, 9) >= 0.03) AS rises
FROM rows4 WINDOW w AS (PARTITION BY {K} ORDER BY date)""")
cte("greenups", "rising seeding", f"""
SELECT r.year, r.tile, r.crop, r.index_name, min(r.date) FILTER (WHERE r.rises AND r.date BETWEEN
  (r.year::VARCHAR || '-' || s.window_start)::DATE AND (r.year::VARCHAR || '-' || s.window_end)::DATE) AS greenup
FROM rising r JOIN seeding s USING (crop) GROUP BY ALL""")


def long_observations(spark: SparkSession, sf: str) -> DataFrame:
    from fieldtide.operators.seasons import long_indices

    return long_indices(observations(spark, sf), SERIES, ("ndvi", "ndwi", "evi"), partition=False)


def windows(spark: SparkSession) -> DataFrame:
    return dimensions.window_dimension(spark, WINDOWS)


def seeding(spark: SparkSession) -> DataFrame:
    return dimensions.seeding_dimension(spark, {}).filter(F.col("crop").isin("Corn", "Rice"))


# ---------------------------------------------------------------- predictions, tiles, boxes

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per year, tile and crop: first and last day, readings and a model error missing for some tiles."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate")
    g = li.groupBy(F.year("l_shipdate").alias("year"), "l_suppkey", "l_returnflag").agg(
        F.min(F.dayofyear("l_shipdate")).alias("pred_start_doy"), F.max(F.dayofyear("l_shipdate")).alias("pred_end_doy"),
        F.count(F.lit(1)).cast("int").alias("num_observations"),
    )
    k = F.col("l_suppkey")
    return g.select(
        "year", _tile_of(k).alias("tile"), _crop_of(F.col("l_returnflag")).alias("crop"), "pred_start_doy", "pred_end_doy",
        F.when(F.col("num_observations") % 9 != 0, F.col("num_observations")).alias("num_observations"),
        F.when(k % 5 != 0, F.lit(10.0) + (k % 7) * 1.25).alias("model_test_mae_days"),
    )


cte("predictions", "", """
SELECT year, (k % 20)::VARCHAR || '_' || (k // 20)::VARCHAR AS tile,
  CASE f WHEN 'A' THEN 'Corn' WHEN 'N' THEN 'Rice' ELSE 'Rye' END AS crop, pred_start_doy, pred_end_doy,
  CASE WHEN c % 9 <> 0 THEN c END AS num_observations,
  CASE WHEN k % 5 <> 0 THEN 10::DOUBLE + (k % 7) * 1.25::DOUBLE END AS model_test_mae_days
FROM (SELECT year(l_shipdate)::INT AS year, l_suppkey AS k, l_returnflag AS f, min(dayofyear(l_shipdate))::INT AS pred_start_doy,
        max(dayofyear(l_shipdate))::INT AS pred_end_doy, count(*)::INT AS c FROM lineitem GROUP BY ALL)""")


def with_cell_bounds(df: DataFrame, key: str) -> DataFrame:
    """Adds the bounds of the region's cell assigned to an integer key."""
    k = F.col(key)
    i, j = (k % 20).cast("int"), (F.floor(k / 20) % 20).cast("int")
    return df.withColumns({
        "lon_min": grid_edge(i, C.REGION["lon_min"], C.REGION["lon_max"], 20),
        "lat_min": grid_edge(j, C.REGION["lat_min"], C.REGION["lat_max"], 20),
        "lon_max": grid_edge(i + 1, C.REGION["lon_min"], C.REGION["lon_max"], 20),
        "lat_max": grid_edge(j + 1, C.REGION["lat_min"], C.REGION["lat_max"], 20),
    })


def _edge_sql(index: str, low: float, high: float) -> str:
    return f"CASE WHEN {index} = 20 THEN {lit(high)} ELSE {lit(low)} + ({index})::DOUBLE * (({lit(high)} - {lit(low)}) / 20::DOUBLE) END"


def cell_bounds_sql(i: str, j: str) -> str:
    r = C.REGION
    return (
        f"{_edge_sql(i, r['lon_min'], r['lon_max'])} AS lon_min, {_edge_sql(j, r['lat_min'], r['lat_max'])} AS lat_min, "
        f"{_edge_sql(f'({i} + 1)', r['lon_min'], r['lon_max'])} AS lon_max, {_edge_sql(f'({j} + 1)', r['lat_min'], r['lat_max'])} AS lat_max"
    )


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", _tile_of(F.col("s_suppkey")).alias("tile"))
    return with_cell_bounds(s, "s_suppkey").drop("s_suppkey")


cte("tiles", "", f"""
SELECT (s_suppkey % 20)::VARCHAR || '_' || (s_suppkey // 20)::VARCHAR AS tile,
  {cell_bounds_sql('(s_suppkey % 20)', '((s_suppkey // 20) % 20)')} FROM supplier""")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    lon = F.lit(C.REGION["lon_min"]) + (k % 5) * 1.0
    lat = F.lit(C.REGION["lat_min"]) + F.floor(k / 5) * 0.7
    return n.select(
        k.cast("bigint").alias("request_id"), (F.lit(1995) + k % 7).cast("int").alias("year"), lon.alias("lon_min"),
        lat.alias("lat_min"), (lon + 0.6 + (k % 3) * 0.25).alias("lon_max"), (lat + 0.5).alias("lat_max"),
    )


cte("boxes", "", f"""
SELECT n_nationkey::BIGINT AS request_id, 1995 + n_nationkey % 7 AS year, lon AS lon_min, lat AS lat_min,
  lon + 0.6::DOUBLE + (n_nationkey % 3) * 0.25::DOUBLE AS lon_max, lat + 0.5::DOUBLE AS lat_max
FROM (SELECT n_nationkey, {lit(C.REGION['lon_min'])} + (n_nationkey % 5) * 1::DOUBLE AS lon,
        {lit(C.REGION['lat_min'])} + (n_nationkey // 5) * 0.7::DOUBLE AS lat FROM nation)""")
cte("pairs", "tiles boxes", """
SELECT b.request_id, b.year, t.tile FROM boxes b JOIN tiles t
  ON t.lon_min <= b.lon_max AND t.lon_max >= b.lon_min AND t.lat_min <= b.lat_max AND t.lat_max >= b.lat_min""")


# ---------------------------------------------------------------- pixels

_MIX = {"B4": (1, 0), "B8": (7, 3), "B2": (5, 1), "B3": (11, 2), "B11": (13, 5)}


def pixels(spark: SparkSession, sf: str, bands: tuple[str, ...] = PIXEL_BANDS) -> DataFrame:
    """8x8 chips: eight dates per tile, integer bands with zeros, and a class layer."""
    emb = table(spark, sf, "embeddings")
    rows = emb.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    value = lambda a, b: F.greatest(
        F.floor((F.element_at("embedding", ((F.col("pos") * a + b) % 64 + 1).cast("int")).cast("double") + 0.1) * 10000), F.lit(0)
    ).cast("int")
    t = F.floor(F.col("vec_id") / 8)
    return rows.select(
        "vec_id", tile_name((t % 20).cast("bigint"), F.floor(t / 20).cast("bigint")).alias("tile"),
        F.date_add(F.lit("2024-06-01").cast("date"), (F.col("vec_id") % 8 * 5).cast("int")).alias("date"),
        F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"),
        *[value(*_MIX[b]).alias(b) for b in bands],
        ((F.col("vec_id") * 7 + F.col("pos") * 3) % 12).cast("int").alias("scl"),
    )


def _dn(b: str) -> str:
    a, o = _MIX[b]
    return f"greatest(floor((embedding[(p.pos * {a} + {o}) % 64 + 1]::DOUBLE + 0.1::DOUBLE) * 10000), 0)::INT AS {b}"


cte("px", "", f"""
SELECT vec_id, ((vec_id // 8) % 20)::VARCHAR || '_' || (vec_id // 160)::VARCHAR AS tile,
  DATE '2024-06-01' + (vec_id % 8 * 5)::INT AS date, (p.pos // 8)::INT AS row, (p.pos % 8)::INT AS col,
  {', '.join(_dn(b) for b in PIXEL_BANDS)}, ((vec_id * 7 + p.pos * 3) % 12)::INT AS scl
FROM embeddings, range(64) p(pos)""")


def scenes_8bit(spark: SparkSession, sf: str, bands: tuple[str, ...] = ("B4", "B3", "B2")) -> DataFrame:
    """All chips of all dates with values in 0..255."""
    return pixels(spark, sf, bands).select("tile", "date", "row", "col", *[F.floor(F.col(b) % 256).cast("int").alias(b) for b in bands])


cte("chips", "px", "SELECT tile, date, row, col, B4 % 256 AS B4, B3 % 256 AS B3, B2 % 256 AS B2 FROM px")


def scene_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Every box asks for every date."""
    day = F.date_add(F.lit("2024-06-01").cast("date"), F.col("_k") * 5)
    return boxes(spark, sf).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("date", day).drop("_k")


cte("dboxes", "boxes", "SELECT b.*, DATE '2024-06-01' + (k * 5)::INT AS date FROM boxes b, range(8) r(k)")


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """Crop class per tile pixel, from the mean red value of all dates."""
    mean = F.floor(F.sum("B4") / F.count(F.lit(1)))
    px = pixels(spark, sf, ("B4",)).groupBy("tile", "row", "col").agg(mean.alias("v"))
    v = F.col("v")
    return px.select("tile", "row", "col", F.when(v > 1500, 1).when(v < 600, 5).when(v < 900, 0).otherwise(3).alias("label"))


cte("mask", "px", """
SELECT tile, row, col, CASE WHEN v > 1500 THEN 1 WHEN v < 600 THEN 5 WHEN v < 900 THEN 0 ELSE 3 END AS label
FROM (SELECT tile, row, col, floor(sum(B4) / count(*)) AS v FROM px GROUP BY ALL)""")


def crops(spark: SparkSession) -> DataFrame:
    return dimensions.crop_dimension(spark, LEGEND)


cte("crops", "", "SELECT * FROM (VALUES (1,'Corn'),(3,'Rice'),(5,'Soybeans'),(27,'Rye')) AS v(label, crop)")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Georeferencing of every tile: its cell of the region, eight pixels a side, moved by half a pixel for odd tiles."""
    emb = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("t")).distinct()
    rows = with_cell_bounds(emb, "t")
    t = F.col("t")
    x0 = F.col("lon_min") + (t % 2) * (CHIP_RES * 3)
    y0 = F.col("lat_max")
    return rows.select(
        tile_name((t % 20).cast("bigint"), F.floor(t / 20).cast("bigint")).alias("tile"), x0.alias("x0"), y0.alias("y0"),
        F.lit(CHIP_RES).alias("dx"), F.lit(-CHIP_RES_LAT).alias("dy"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        x0.alias("lon_min"), (y0 - CHIP_RES_LAT * 8).alias("lat_min"), (x0 + CHIP_RES * 8).alias("lon_max"),
        y0.alias("lat_max"), F.lit("EPSG:4326").alias("crs"),
    )


cte("headers", "", f"""
SELECT (t % 20)::VARCHAR || '_' || (t // 20)::VARCHAR AS tile, x0, y0, {lit(CHIP_RES)} AS dx, {lit(-CHIP_RES_LAT)} AS dy,
  x0 AS lon_min, y0 - {lit(CHIP_RES_LAT * 8)} AS lat_min, x0 + {lit(CHIP_RES * 8)} AS lon_max, y0 AS lat_max
FROM (SELECT t, lon_min + (t % 2) * {lit(CHIP_RES * 3)} AS x0, lat_max AS y0
  FROM (SELECT t, {cell_bounds_sql('(t % 20)', '((t // 20) % 20)')}
    FROM (SELECT DISTINCT vec_id // 8 AS t FROM embeddings)))""")


# ---------------------------------------------------------------- acquisitions

def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    """Acquisition quality per month, tile and date from events: unusable when too many of the day's events are errors."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type")
    g = ev.groupBy(_tile_of(F.col("user_id")).alias("tile"), F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("event_type") == "error").alias("e"), F.count(F.lit(1)).alias("n")
    )
    return g.select(F.date_format("date", "yyyy-MM").alias("month"), "tile", "date", (F.col("e") * 3 <= F.col("n")).alias("valid"))


cte("acq", "", """
SELECT strftime(date, '%Y-%m') AS month, tile, date, e * 3 <= n AS valid FROM (
  SELECT (user_id % 20)::VARCHAR || '_' || (user_id // 20)::VARCHAR AS tile, ts::DATE AS date,
    count(*) FILTER (WHERE event_type = 'error') AS e, count(*) AS n FROM events GROUP BY ALL)""")


def requested_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of a plan, one per customer, with a flag for those that have a data folder."""
    c = table(spark, sf, "customer").select("c_custkey")
    return c.select(
        F.when(F.floor(F.col("c_custkey") / 20) % 10 == 9, "2024-02").otherwise("2024-01").alias("month"),
        _tile_of(F.col("c_custkey")).alias("tile"), (F.col("c_custkey") % 10 != 9).alias("known"),
    )


cte("wanted", "", """
SELECT CASE WHEN (c_custkey // 20) % 10 = 9 THEN '2024-02' ELSE '2024-01' END AS month, (c_custkey % 20)::VARCHAR || '_' || (c_custkey // 20)::VARCHAR AS tile,
  c_custkey % 10 <> 9 AS known FROM customer""")
cte("coverage", "acq", "SELECT month, date, count(*) AS tiles FROM acq WHERE valid GROUP BY ALL")
cte("planacq", "acq wanted", "SELECT acq.* FROM acq JOIN wanted USING (month, tile) WHERE known")
cte("plancov", "planacq", "SELECT month, date, count(*) AS tiles FROM planacq WHERE valid GROUP BY ALL")
cte("anchor", "plancov", "SELECT month, (list(date ORDER BY tiles DESC, date DESC))[1] AS anchor_date, max(tiles) AS anchor_tiles FROM plancov GROUP BY month")
cte("nearest", "planacq anchor", """
SELECT month, tile, any_value(anchor_date) AS anchor_date,
  (list(date ORDER BY abs(date_diff('day', anchor_date, date)), date DESC) FILTER (WHERE valid))[1] AS chosen
FROM planacq LEFT JOIN anchor USING (month) GROUP BY month, tile""")
cte("planned", "wanted nearest", """
SELECT w.month, w.tile, CASE WHEN NOT w.known THEN 'meta_patch_missing' WHEN x.tile IS NULL THEN 'no_dates_in_month'
    WHEN x.chosen IS NULL THEN 'no_valid_observation' ELSE 'valid_tiles' END AS status,
  CASE WHEN w.known THEN x.chosen END AS date,
  CASE WHEN w.known AND x.chosen IS NOT NULL THEN abs(date_diff('day', x.anchor_date, x.chosen)) END AS gap_days,
  CASE WHEN w.known AND x.chosen IS NOT NULL THEN x.anchor_date END AS anchor_date
FROM wanted w LEFT JOIN nearest x USING (month, tile)""")
