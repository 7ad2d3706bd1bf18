"""Pixel, raster, field and model plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide import constants as C
from fieldtide.functions import indices as X, text as T
from fieldtide.operators import (
    chunks, components, observations as O, quality as Q, raster as Z, scoring, spatial, stretch,
)
from fieldtide.plans import relations as R, season_plans  # noqa: F401 - its common tables are used here
from fieldtide.plans.registry import bit, day, plan, r6

RGB = ("B4", "B3", "B2")
L = R.lit


IMAGE = ("tile", "date")


def _image_sizes(spark, sf, **extra):
    """Sizes of every image, one per tile and date."""
    images = R.pixels(spark, sf, ()).select(*IMAGE).distinct()
    return images.withColumns({"height": F.lit(8), "width": F.lit(8), **{k: F.lit(v) for k, v in extra.items()}})


# ---------------------------------------------------------------- observations and quality

R.cte("masked", "px mask crops", """
SELECT p.tile, p.row, p.col, p.date, p.scl, c.crop, p.B2 / 10000::DOUBLE AS b, p.B4 / 10000::DOUBLE AS r, p.B8 / 10000::DOUBLE AS n, p.B11 / 10000::DOUBLE AS s
FROM px p JOIN mask m USING (tile, row, col) JOIN crops c USING (label) WHERE m.label <> 0 AND p.B4 <> 0""")
R.cte("maskidx", "masked", """
SELECT tile, row, col, date, crop, scl NOT IN (3, 8, 9, 10, 11) AS ok, greatest(least((n - r) / (n + r + 1e-10), 1), -1) AS ndvi,
  greatest(least((n - s) / (n + s + 1e-10), 1), -1) AS ndwi,
  greatest(least(2.5::DOUBLE * (n - r) / (n + 6::DOUBLE * r - 7.5::DOUBLE * b + 1::DOUBLE + 1e-10), 1), -1) AS evi FROM masked""")


@plan("crop_date_means", R.sql("maskidx", """
SELECT tile, crop, date::VARCHAR AS date, round(coalesce(avg(ndvi) FILTER (WHERE ok), -9), 6) AS ndvi,
  round(coalesce(avg(ndwi) FILTER (WHERE ok), -9), 6) AS ndwi, round(coalesce(avg(evi) FILTER (WHERE ok), -9), 6) AS evi
FROM maskidx GROUP BY tile, crop, maskidx.date"""))
def crop_date_means(spark, sf):
    out = O.crop_date_means(R.pixels(spark, sf), R.mask(spark, sf), R.crops(spark))
    return out.select("tile", "crop", day("date").alias("date"), *[r6(F.coalesce(c, F.lit(-9.0))).alias(c) for c in ("ndvi", "ndwi", "evi")])


@plan("rescale_guard", R.sql("px", """
SELECT tile, date::VARCHAR AS date, row, col, round(CASE WHEN max(v) OVER (PARTITION BY tile, date) > 1.5 THEN v / 10000::DOUBLE ELSE v END, 6) AS v
FROM (SELECT tile, date, row, col, CASE WHEN vec_id % 2 = 0 THEN B8::DOUBLE ELSE B8 / 10000::DOUBLE END AS v FROM px)"""))
def rescale_guard(spark, sf):
    v = F.when(F.col("vec_id") % 2 == 0, F.col("B8").cast("double")).otherwise(F.col("B8") / 10000.0)
    px = R.pixels(spark, sf, ("B8",)).select("tile", "date", "row", "col", v.alias("v"))
    return O.rescale_guard(px, ["tile", "date"], "v").select("tile", day("date").alias("date"), "row", "col", r6("v").alias("v"))


_CLOUD = """
count(*) AS pixels, count(*) FILTER (WHERE scl > 7) / count(*) AS cloud, coalesce(count(*) FILTER (WHERE scl > 7) / nullif(count(*) FILTER (WHERE scl > 0), 0), 1) AS ratio,
  count(*) FILTER (WHERE B2 = 0 AND B3 = 0 AND B4 = 0) / count(*) AS blank, count(*) FILTER (WHERE B2 <= 200 AND B3 <= 200 AND B4 <= 200) / count(*) AS black"""
R.cte("cloudstats", "px", f"SELECT tile, date, {_CLOUD} FROM px GROUP BY tile, date")


@plan("cloud_stats", R.sql("cloudstats", """
SELECT tile, date::VARCHAR AS date, pixels, round(cloud, 6) AS cloud_fraction, round(ratio, 6) AS scl_cloud_ratio, round(blank, 6) AS blank_fraction,
  round(black, 6) AS black_ratio FROM cloudstats"""))
def cloud_stats(spark, sf):
    out = Q.cloud_stats(R.pixels(spark, sf), black_threshold=200)
    return out.select("tile", day("date").alias("date"), "pixels", *[r6(c).alias(c) for c in ("cloud_fraction", "scl_cloud_ratio", "blank_fraction", "black_ratio")])


@plan("quality_gate", R.sql("px cloudstats", """
SELECT tile, date::VARCHAR AS date, row, col, B4 FROM px JOIN cloudstats USING (tile, date) WHERE cloud <= 0.34 AND blank <= 0.02"""))
def quality_gate(spark, sf):
    out = Q.quality_gate(R.pixels(spark, sf, ("B2", "B3", "B4")), 0.34, 0.02)
    return out.select("tile", day("date").alias("date"), "row", "col", "B4")


@plan("quality_gate_export", R.sql("cloudstats", """
SELECT tile, date::VARCHAR AS date, round(ratio, 6) AS scl_cloud_ratio, round(black, 6) AS black_ratio,
  CASE WHEN ratio > 0.36 THEN 'cloud' WHEN black > 0.03 THEN 'black' ELSE '' END AS reason, (NOT (ratio > 0.36 OR black > 0.03))::INT AS keep FROM cloudstats"""))
def quality_gate_export(spark, sf):
    out = Q.quality_gate_export(R.pixels(spark, sf, ("B2", "B3", "B4")), 0.36, 0.03, 200)
    return out.select("tile", day("date").alias("date"), r6("scl_cloud_ratio").alias("scl_cloud_ratio"), r6("black_ratio").alias("black_ratio"),
                      F.coalesce("reason", F.lit("")).alias("reason"), bit("keep").alias("keep"))


@plan("monthly_median", R.sql("px", """
SELECT tile, strftime(date, '%Y-%m') AS month, row, col, least(floor(median(B4) + 0.5), 65535)::INT AS B4, least(floor(median(B8) + 0.5), 65535)::INT AS B8
FROM px WHERE scl IN (4, 5, 6, 7) GROUP BY ALL"""))
def monthly_median(spark, sf):
    return Q.monthly_median(R.pixels(spark, sf, ("B4", "B8")), bands=("B4", "B8"))


@plan("scene_counts", R.sql("px", """
SELECT tile, count(*) AS scenes, string_agg(date::VARCHAR, ',' ORDER BY date) AS dates FROM (SELECT DISTINCT tile, date FROM px) GROUP BY tile"""))
def scene_counts(spark, sf):
    scenes = R.pixels(spark, sf, ("B4",)).filter("row = 0 and col = 0").select("tile", "date")
    return Q.scene_counts(scenes).select("tile", "scenes", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


R.cte("scenes", "px headers", """
SELECT p.tile, p.date, avg((scl > 7)::INT) * 100 AS cloud, any_value(h.lon_min) AS lon_min, any_value(h.lat_min) AS lat_min, any_value(h.lon_max) AS lon_max, any_value(h.lat_max) AS lat_max
FROM px p JOIN headers h USING (tile) GROUP BY p.tile, p.date""")


def _scenes(spark, sf):
    px = R.pixels(spark, sf, ("B4",))
    g = px.groupBy("tile", "date").agg((F.avg((F.col("scl") > 7).cast("int")) * 100).alias("cloud"))
    return g.join(R.headers(spark, sf).select("tile", *spatial.BOUNDS), "tile")


@plan("select_scenes", R.sql("scenes", """
SELECT tile, date::VARCHAR AS date, round(cloud, 6) AS cloud FROM scenes WHERE date >= DATE '2024-06-06' AND date < DATE '2024-07-01' AND cloud < 34
  AND lon_min <= -91 AND lon_max >= -94 AND lat_min <= 34 AND lat_max >= 32.9"""))
def select_scenes(spark, sf):
    box = {"lon_min": -94.0, "lat_min": 32.9, "lon_max": -91.0, "lat_max": 34.0}
    out = Q.select_scenes(_scenes(spark, sf), "2024-06-06", "2024-07-01", 34.0, box)
    return out.select("tile", day("date").alias("date"), r6("cloud").alias("cloud"))


@plan("best_scene_per_day", R.sql("scenes", """
SELECT date::VARCHAR AS date, round(min(cloud), 6) AS cloud, (list(tile ORDER BY cloud, tile))[1] AS id FROM scenes GROUP BY scenes.date"""))
def best_scene_per_day(spark, sf):
    from fieldtide.operators.planning import best_scene_per_day as best

    s = _scenes(spark, sf).select("date", "cloud", F.col("tile").alias("id"))
    return best(s).select(day("date").alias("date"), r6("cloud").alias("cloud"), "id")


@plan("channel_stats", R.sql("px", " UNION ALL ".join(f"""
SELECT tile, date::VARCHAR AS date, '{b}' AS channel, min({b}) AS min, max({b}) AS max, round(avg({b}), 6) AS mean, count(*) FILTER (WHERE {b} <> 0) AS nonzero,
  count(*) AS pixels, round(count(*) FILTER (WHERE B4 > 0 OR B3 > 0 OR B2 > 0) / count(*), 6) AS signal_fraction FROM px GROUP BY tile, px.date""" for b in RGB)))
def channel_stats(spark, sf):
    out = Q.channel_stats(R.pixels(spark, sf, RGB), RGB)
    return out.select("tile", day("date").alias("date"), "channel", "min", "max", r6("mean").alias("mean"), "nonzero", "pixels", r6("signal_fraction").alias("signal_fraction"))


@plan("scl_policies", R.sql("px", """
SELECT tile, date::VARCHAR AS date, count(*) FILTER (WHERE scl NOT IN (3, 8, 9, 10, 11)) AS bad, count(*) FILTER (WHERE scl IN (4, 5, 6, 7)) AS keep,
  count(*) FILTER (WHERE scl IN (4, 5, 7)) AS keep_land, count(*) FILTER (WHERE scl <> 6) AS not_water, count(*) FILTER (WHERE scl <= 7) AS cloud FROM px GROUP BY tile, px.date"""))
def scl_policies(spark, sf):
    """Usable pixels of an image under each mask policy."""
    usable = lambda *a: F.count_if(X.scl_valid(F.col("scl"), *a))
    out = R.pixels(spark, sf).groupBy("tile", "date").agg(
        usable("bad").alias("bad"), usable("keep").alias("keep"), usable("keep", True).alias("keep_land"), usable("not_water").alias("not_water"), usable("cloud").alias("cloud"))
    return out.withColumn("date", day("date"))


@plan("stack_bands", R.sql("px", """
, fine AS MATERIALIZED (SELECT tile, date, row, col, row // 2 AS r, col // 2 AS c, B4 FROM px),
coarse AS MATERIALIZED (SELECT tile, date, row // 2 AS r, col // 2 AS c, B11 FROM px WHERE row % 2 = 0 AND col % 2 = 0)
SELECT tile, f.date::VARCHAR AS date, row, col, B4, B11 FROM fine f JOIN coarse USING (tile, date, r, c)"""))
def stack_bands(spark, sf):
    px = R.pixels(spark, sf, ("B4", "B11"))
    coarse = px.filter("row % 2 = 0 and col % 2 = 0").select(
        "tile", "date", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"), "B11")
    sizes = px.select("tile", "date").distinct().withColumns(
        {"fine_height": F.lit(8), "fine_width": F.lit(8), "coarse_height": F.lit(4), "coarse_width": F.lit(4)})
    out = Z.stack_bands(px.select("tile", "date", "row", "col", "B4"), coarse, sizes, ["B11"])
    return out.withColumn("date", day("date"))


@plan("pivot_bands", R.sql("px", """
SELECT tile, date::VARCHAR AS date, row, col, B4, B8 FROM px WHERE vec_id % 3 <> 0"""))
def pivot_bands(spark, sf):
    from fieldtide.sources.pixels import pivot_bands as pivot

    px = R.pixels(spark, sf, ("B4", "B8"))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in ("B4", "B8")])
    long = px.select("vec_id", "tile", "date", "row", "col", F.inline(bands)).filter("vec_id % 3 <> 0 or band = 'B4'")
    return pivot(long.drop("vec_id"), ("B4", "B8")).withColumn("date", day("date"))


@plan("palette_lookup", R.sql("mask", "SELECT tile, row, col, name, hex FROM (SELECT *, CASE WHEN label + row > 5 THEN 0 ELSE label + row END AS k FROM mask) JOIN (VALUES "
      + ", ".join(f"({k}, '{n}', '#{r:02x}{g:02x}{b:02x}')" for k, n, r, g, b in C.PALETTE) + ") AS v(k, name, hex) USING (k)"))
def palette_lookup(spark, sf):
    m = R.mask(spark, sf).withColumn("p", X.palette_lookup(F.col("label") + F.col("row")))
    return m.select("tile", "row", "col", "p.name", "p.hex")


@plan("argmax_class", """
SELECT vec_id, (list_position(embedding[1:8], list_max(embedding[1:8])) - 1)::INT AS label, (list_position(embedding, list_max(embedding)) - 1)::INT AS wide FROM embeddings""")
def argmax_class(spark, sf):
    e = R.table(spark, sf, "embeddings")
    return e.select("vec_id", X.argmax_class(F.slice("embedding", 1, 8)).alias("label"), X.argmax_class(F.col("embedding")).alias("wide"))


# ---------------------------------------------------------------- mosaics

RES_X, RES_Y = R.CHIP_RES, R.CHIP_RES_LAT
R.cte("canvas", "boxes", f"""
SELECT *, unnest(range(h)) AS row FROM (SELECT *, greatest(ceil(round((lon_max - lon_min) / {L(RES_X)}, 6)), 1)::INT AS w,
  greatest(ceil(round((lat_max - lat_min) / {L(RES_Y)}, 6)), 1)::INT AS h FROM boxes)""")
R.cte("spots", "canvas", f"""
SELECT *, lon_min + (col + 0.5::DOUBLE) * {L(RES_X)} AS x, lat_max - (row + 0.5::DOUBLE) * {L(RES_Y)} AS y FROM (SELECT *, unnest(range(w)) AS col FROM canvas)""")
# Looks from every position into the tiles that cover its centre, the other way round than the operator's scatter.
R.cte("looked", "spots headers", """
SELECT s.request_id, s.row, s.col, h.tile, floor(round((s.x - h.x0) / h.dx, 6))::INT AS tc, floor(round((s.y - h.y0) / h.dy, 6))::INT AS tr
FROM spots s JOIN headers h ON h.lon_min <= s.lon_max AND h.lon_max >= s.lon_min AND h.lat_min <= s.lat_max AND h.lat_max >= s.lat_min
  AND s.x >= h.lon_min - 1e-5 AND s.x <= h.lon_max + 1e-5 AND s.y >= h.lat_min - 1e-5 AND s.y <= h.lat_max + 1e-5""")
R.cte("inside", "looked chips", """
SELECT l.request_id, l.row, l.col, c.date, c.B4, c.B3, c.B2, split_part(l.tile, '_', 1)::INT AS ti, split_part(l.tile, '_', 2)::INT AS tj
FROM looked l JOIN chips c ON c.tile = l.tile AND c.row = l.tr AND c.col = l.tc WHERE c.B4 > 0 OR c.B3 > 0 OR c.B2 > 0""")


def _mosaic_cte(name: str, direction: str) -> None:
    R.cte(name, "inside spots dboxes", f"""
SELECT g.request_id, d.date, g.row::INT AS row, g.col::INT AS col, coalesce(t.v.a, 0)::INT AS B4, coalesce(t.v.b, 0)::INT AS B3, coalesce(t.v.c, 0)::INT AS B2
FROM spots g JOIN dboxes d USING (request_id)
  LEFT JOIN (SELECT request_id, date, row, col, (list({{'a': B4, 'b': B3, 'c': B2}} ORDER BY ti {direction}, tj {direction}))[1] AS v FROM inside GROUP BY ALL) t
  ON t.request_id = g.request_id AND t.date = d.date AND t.row = g.row AND t.col = g.col""")


_mosaic_cte("mosaic1", "ASC")
_mosaic_cte("mosaic9", "DESC")


def _mosaic(spark, sf, last=False):
    return Z.mosaic(R.scenes_8bit(spark, sf), R.headers(spark, sf), R.scene_boxes(spark, sf), RGB, RES_X, RES_Y, last=last, layers=("date",))


@plan("mosaic_first", R.sql("mosaic1", "SELECT request_id, date::VARCHAR AS date, row, col, B4, B3, B2 FROM mosaic1"))
def mosaic_first(spark, sf):
    return _mosaic(spark, sf).withColumn("date", day("date"))


@plan("mosaic_last", R.sql("mosaic9", "SELECT request_id, date::VARCHAR AS date, row, col, B4, B3, B2 FROM mosaic9"))
def mosaic_last(spark, sf):
    return _mosaic(spark, sf, True).withColumn("date", day("date"))


@plan("coverage_fraction", R.sql("mosaic1", """
SELECT request_id, date::VARCHAR AS date, round(avg((B4 > 0 OR B3 > 0 OR B2 > 0)::INT), 6) AS coverage, (avg((B4 > 0 OR B3 > 0 OR B2 > 0)::INT) < 0.999999)::INT AS partial
FROM mosaic1 GROUP BY request_id, mosaic1.date"""))
def coverage_fraction(spark, sf):
    out = Z.coverage_fraction(_mosaic(spark, sf), RGB, ("request_id", "date"))
    return out.select("request_id", day("date").alias("date"), r6("coverage").alias("coverage"), bit("partial").alias("partial"))


@plan("valid_extent", R.sql("mosaic1", """
SELECT request_id, date::VARCHAR AS date, min(row) AS row0, max(row) + 1 AS row1, min(col) AS col0, max(col) + 1 AS col1 FROM mosaic1
WHERE B4 > 0 OR B3 > 0 OR B2 > 0 GROUP BY request_id, mosaic1.date"""))
def valid_extent(spark, sf):
    return Z.valid_extent(_mosaic(spark, sf), RGB, ["request_id", "date"]).withColumn("date", day("date"))


@plan("mask_to_valid", R.sql("chips px", """
SELECT c.tile, c.date::VARCHAR AS date, c.row, c.col, CASE WHEN split_part(c.tile, '_', 1)::INT % 3 = 0 OR v.tile IS NOT NULL THEN c.B4 ELSE 0 END AS B4
FROM chips c LEFT JOIN (SELECT DISTINCT tile, date, row, col FROM px WHERE B8 > 0) v USING (tile, date, row, col)"""))
def mask_to_valid(spark, sf):
    valid = R.pixels(spark, sf, ("B8",)).filter("B8 > 0").select(*IMAGE, "row", "col")
    odd = T.tile_i(F.col("tile")) % 3 == 0
    sizes = _image_sizes(spark, sf).withColumns({"valid_height": F.when(odd, 9).otherwise(8), "valid_width": F.lit(8)})
    return Z.mask_to_valid(R.scenes_8bit(spark, sf, ("B4",)), valid, sizes, ["B4"], IMAGE).withColumn("date", day("date"))


_CW, _CH = (C.REGION["lon_max"] - C.REGION["lon_min"]) / 15, (C.REGION["lat_max"] - C.REGION["lat_min"]) / 15
_NX, _NY = max(1, round(_CW / RES_X)), max(1, round(_CH / RES_Y))
R.cte("cells", "", f"""
SELECT i || '_' || j AS cell, (i + j) % 5 = 0 AS done, r.row::INT AS row, c.col::INT AS col,
  {L(C.REGION['lon_min'])} + i * {L(_CW)} + (c.col + 0.5::DOUBLE) * {L(RES_X)} AS x, {L(C.REGION['lat_min'])} + (j + 1) * {L(_CH)} - (r.row + 0.5::DOUBLE) * {L(RES_Y)} AS y
FROM range(15) a(i), range(15) b(j), range({_NY}) r(row), range({_NX}) c(col)""")
R.cte("incell", "cells headers chips", """
SELECT s.cell, s.done, s.row, s.col, c.date, c.B4, c.B3, split_part(h.tile, '_', 1)::INT AS ti, split_part(h.tile, '_', 2)::INT AS tj
FROM cells s JOIN headers h ON s.x >= h.lon_min - 1e-5 AND s.x <= h.lon_max + 1e-5 AND s.y >= h.lat_min - 1e-5 AND s.y <= h.lat_max + 1e-5
JOIN chips c ON c.tile = h.tile AND c.row = floor(round((s.y - h.y0) / h.dy, 6))::INT AND c.col = floor(round((s.x - h.x0) / h.dx, 6))::INT""")
R.cte("cellreport", "cells incell px", """
SELECT k.cell, d.date, count(n.cell) AS source_pixels, count(*) FILTER (WHERE n.B4 > 0 OR n.B3 > 0) AS signal_pixels,
  CASE WHEN any_value(k.done) THEN 'skipped' WHEN count(*) FILTER (WHERE n.B4 > 0 OR n.B3 > 0) = 0 THEN 'empty' ELSE 'wrote' END AS status
FROM (SELECT DISTINCT cell, done FROM cells) k JOIN (SELECT DISTINCT date FROM px) d ON true LEFT JOIN incell n ON n.cell = k.cell AND n.date = d.date GROUP BY k.cell, d.date""")


def _retiled(spark, sf):
    # Finished cells: those whose indexes add up to a multiple of five.
    done = spark.range(225).select(F.floor(F.col("id") / 15).alias("i"), (F.col("id") % 15).alias("j"))
    done = done.filter((F.col("i") + F.col("j")) % 5 == 0).select(T.tile_name(F.col("i"), F.col("j")).alias("cell"))
    return Z.retile(R.scenes_8bit(spark, sf, ("B4", "B3")), R.headers(spark, sf), ("B4", "B3"), RES_X, RES_Y, C.REGION, 15, 15, existing=done, extra=("date",))


@plan("retile", R.sql("incell", """
SELECT cell, date::VARCHAR AS date, row, col, (list({'a': B4, 'b': B3} ORDER BY ti, tj))[1].a AS B4, (list({'a': B4, 'b': B3} ORDER BY ti, tj))[1].b AS B3
FROM incell WHERE NOT done AND (B4 > 0 OR B3 > 0) GROUP BY cell, incell.date, row, col"""))
def retile(spark, sf):
    return _retiled(spark, sf)[0].withColumn("date", day("date"))


@plan("retile_report", R.sql("cellreport", "SELECT cell, date::VARCHAR AS date, source_pixels, signal_pixels, status FROM cellreport"))
def retile_report(spark, sf):
    return _retiled(spark, sf)[1].withColumn("date", day("date"))


@plan("run_report", R.sql("cellreport", """
, marked AS (SELECT date, CASE WHEN source_pixels % 7 = 3 THEN 'failed' ELSE status END AS status FROM cellreport)
SELECT date::VARCHAR AS date, count(*) FILTER (WHERE status = 'wrote') AS wrote, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'failed') AS failed FROM marked GROUP BY marked.date"""))
def run_report(spark, sf):
    """Some cells count as failed, by their number of source pixels."""
    from fieldtide.sources.sinks import run_report as report

    cells = _retiled(spark, sf)[1]
    cells = cells.withColumn("status", F.when(F.col("source_pixels") % 7 == 3, "failed").otherwise(F.col("status")))
    return report(cells, {}, ("date",)).withColumn("date", day("date"))


@plan("retile_bands", R.sql("incell", """
, layers AS (SELECT cell, date, ti, tj, row, col, 'B4' AS band, B4 AS v FROM incell UNION ALL SELECT cell, date, ti, tj, row, col, 'B3', B3 FROM incell)
SELECT cell, date::VARCHAR AS scene, band, row, col, (list(v ORDER BY ti, tj))[1] AS value, '2024-02-29' AS date FROM layers WHERE v > 0 GROUP BY cell, layers.date, band, row, col"""))
def retile_bands(spark, sf):
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in ("B4", "B3")])
    long = R.scenes_8bit(spark, sf, ("B4", "B3")).select("tile", day("date").alias("scene"), "row", "col", F.inline(bands))
    out, _ = Z.retile_bands(long, R.headers(spark, sf), 2024, 2, 31, RES_X, RES_Y, C.REGION, 15, 15, layers=("scene",))
    return out.withColumn("date", day("date"))


# ---------------------------------------------------------------- resampling

@plan("resample_nearest", R.sql("chips", """
SELECT tile, date::VARCHAR AS date, r.t::INT AS row, c.t::INT AS col, B4 FROM chips, range(13) r(t), range(5) c(t)
WHERE row = floor((r.t + 0.5) * 8 / 13)::INT AND col = floor((c.t + 0.5) * 8 / 5)::INT"""))
def resample_nearest(spark, sf):
    px = R.scenes_8bit(spark, sf, ("B4",))
    return Z.resample_nearest(px, _image_sizes(spark, sf, target_height=13, target_width=5), IMAGE).withColumn("date", day("date"))


def _lin(t: str, big: int) -> str:
    return f"(({t}.t + 0.5::DOUBLE) * 8::DOUBLE / {big}::DOUBLE - 0.5::DOUBLE)"


@plan("resample_bilinear", R.sql("chips", f"""
, w AS (SELECT tile, date::VARCHAR AS date, r.t::INT AS row, c.t::INT AS col, B4, (1 - abs({_lin('r', 20)} - row)) * (1 - abs({_lin('c', 12)} - col)) AS w
  FROM chips, range(20) r(t), range(12) c(t) WHERE abs({_lin('r', 20)} - row) < 1 - 1e-9 AND abs({_lin('c', 12)} - col) < 1 - 1e-9)
SELECT tile, date, row, col, round(sum(w * B4) / sum(w), 6) AS B4 FROM w GROUP BY ALL"""))
def resample_bilinear(spark, sf):
    px = R.scenes_8bit(spark, sf, ("B4",))
    out = Z.resample_bilinear(px, _image_sizes(spark, sf, target_height=20, target_width=12), ["B4"], IMAGE)
    return out.withColumns({"B4": r6("B4"), "date": day("date")})


@plan("resample_bilinear_down", R.sql("chips", """
, p AS (SELECT r.t AS tr, c.t AS tc, (r.t + 0.5::DOUBLE) * 8::DOUBLE / 3::DOUBLE - 0.5::DOUBLE AS y, (c.t + 0.5::DOUBLE) * 8::DOUBLE / 5::DOUBLE - 0.5::DOUBLE AS x FROM range(3) r(t), range(5) c(t)),
w AS (SELECT tile, date::VARCHAR AS date, tr::INT AS row, tc::INT AS col, B4, (1 - abs(y - row)) * (1 - abs(x - col)) AS w
  FROM chips JOIN p ON row IN (floor(y), floor(y) + 1) AND col IN (floor(x), floor(x) + 1) WHERE (1 - abs(y - row)) * (1 - abs(x - col)) > 1e-12)
SELECT tile, date, row, col, round(sum(w * B4) / sum(w), 6) AS B4 FROM w GROUP BY ALL"""))
def resample_bilinear_down(spark, sf):
    px = R.scenes_8bit(spark, sf, ("B4",))
    out = Z.resample_bilinear(px, _image_sizes(spark, sf, target_height=3, target_width=5), ["B4"], IMAGE)
    return out.withColumns({"B4": r6("B4"), "date": day("date")})


@plan("block_average", R.sql("chips", """
, w AS (SELECT tile, date::VARCHAR AS date, r.t::INT AS row, c.t::INT AS col, B4, (least((row + 1) * 3 / 8::DOUBLE, r.t + 1) - greatest(row * 3 / 8::DOUBLE, r.t)) * (least((col + 1) * 3 / 8::DOUBLE, c.t + 1) - greatest(col * 3 / 8::DOUBLE, c.t)) AS w
  FROM chips, range(3) r(t), range(3) c(t) WHERE least((row + 1) * 3 / 8::DOUBLE, r.t + 1) > greatest(row * 3 / 8::DOUBLE, r.t) AND least((col + 1) * 3 / 8::DOUBLE, c.t + 1) > greatest(col * 3 / 8::DOUBLE, c.t))
SELECT tile, date, row, col, round(sum(w * B4) / sum(w), 6) AS B4 FROM w GROUP BY ALL"""))
def block_average(spark, sf):
    px = R.scenes_8bit(spark, sf, ("B4",))
    return Z.block_average(px, _image_sizes(spark, sf), ["B4"], 3, IMAGE).withColumns({"B4": r6("B4"), "date": day("date")})


@plan("overviews", R.sql("chips", """
SELECT tile, date::VARCHAR AS date, f AS factor, (row // f)::INT AS row, (col // f)::INT AS col, round(avg(B4), 6) AS B4, round(avg(B3), 6) AS B3 FROM chips, (VALUES (2), (4)) v(f) GROUP BY tile, chips.date, f, row // f, col // f"""))
def overviews(spark, sf):
    out = Z.overviews(R.scenes_8bit(spark, sf, ("B4", "B3")), _image_sizes(spark, sf), ["B4", "B3"], IMAGE, min_side=2)
    return out.withColumns({"date": day("date"), **{b: r6(b) for b in ("B4", "B3")}})


def _stretch_sql(valid: str = "") -> str:
    return ", ".join(
        f"round(quantile_cont({b}, 0.02) {valid} * 100) / 100::DOUBLE AS lo_{b}, round(quantile_cont({b}, 0.98) {valid} * 100) / 100::DOUBLE AS hi_{b}" for b in RGB)


R.cte("cuts", "px", f"SELECT tile, date, {_stretch_sql()} FROM px GROUP BY tile, date")

@plan("percentile_stretch", R.sql("px cuts", "SELECT tile, date::VARCHAR AS date, row, col, " + ", ".join(
    f"floor(greatest(least(({b} - lo_{b}) / (CASE WHEN hi_{b} <= lo_{b} THEN lo_{b} + 1 ELSE hi_{b} END - lo_{b}), 1), 0) * 255)::INT AS {b}" for b in RGB)
    + " FROM px JOIN cuts USING (tile, date)"))
def percentile_stretch(spark, sf):
    out = stretch.percentile_stretch(R.pixels(spark, sf, RGB).drop("vec_id", "scl"), RGB)
    return out.withColumn("date", day("date"))


R.cte("lit_px", "px", "SELECT tile, date, row, col, greatest(B4 - 1200, 0) AS B4, greatest(B3 - 1200, 0) AS B3, greatest(B2 - 1200, 0) AS B2 FROM px")
R.cte("lit_cuts", "lit_px", f"""
SELECT tile, date, count(*) FILTER (WHERE B4 > 0 OR B3 > 0 OR B2 > 0) AS n, {_stretch_sql('FILTER (WHERE B4 > 0 OR B3 > 0 OR B2 > 0)')} FROM lit_px GROUP BY tile, date""")


@plan("display_stretch", R.sql("lit_px lit_cuts", "SELECT tile, date::VARCHAR AS date, row, col, " + ", ".join(
    f"CASE WHEN n < 50 OR hi_{b} <= lo_{b} + 1e-6 THEN {b} WHEN B4 > 0 OR B3 > 0 OR B2 > 0 THEN floor(greatest(least(({b} - lo_{b}) / (lo_{b} + (hi_{b} - lo_{b}) - lo_{b}), 1), 0) * 255)::INT ELSE 0 END AS {b}" for b in RGB)
    + " FROM lit_px JOIN lit_cuts USING (tile, date)"))
def display_stretch(spark, sf):
    px = R.pixels(spark, sf, RGB).select("tile", "date", "row", "col", *[F.greatest(F.col(b) - 1200, F.lit(0)).alias(b) for b in RGB])
    return stretch.display_stretch(px, RGB, min_valid=50).withColumn("date", day("date"))


_SIGNAL = "(B4 > 0 OR B3 > 0 OR B2 > 0)"
R.cte("cropped", "mosaic1", f"""
SELECT m.request_id, m.date, m.row - r0 AS row, m.col - c0 AS col, m.B4, m.B3, m.B2, r1 - r0 + 1 AS h, c1 - c0 + 1 AS w
FROM mosaic1 m JOIN (SELECT request_id, date, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM mosaic1 WHERE {_SIGNAL} GROUP BY ALL) e USING (request_id, date)
WHERE m.row BETWEEN r0 AND r1 AND m.col BETWEEN c0 AND c1""")


def _cover(p: str, n: str, new: str) -> str:
    """Overlap of source position ``p`` of ``n`` with target cell ``t`` of ``new``."""
    lo, hi = f"{p} * {new}::DOUBLE / {n}", f"({p} + 1) * {new}::DOUBLE / {n}"
    return f"(least({hi}, t.t + 1::DOUBLE) - greatest({lo}, t.t::DOUBLE))"


R.cte("resized", "cropped", """
SELECT *, CASE WHEN greatest(h, w) <= 20 THEN h ELSE greatest(round_even(h * (20::DOUBLE / greatest(h, w)), 0), 1) END AS nh,
  CASE WHEN greatest(h, w) <= 20 THEN w ELSE greatest(round_even(w * (20::DOUBLE / greatest(h, w)), 0), 1) END AS nw FROM cropped""")
R.cte("by_row", "resized", f"SELECT r.*, t.t AS tr, {_cover('row', 'h', 'nh')} AS wr FROM resized r, range(20) t(t) WHERE t.t < nh AND {_cover('row', 'h', 'nh')} > 1e-9")
R.cte("by_cell", "by_row", f"SELECT r.*, t.t AS tc, wr * {_cover('col', 'w', 'nw')} AS wt FROM by_row r, range(20) t(t) WHERE t.t < nw AND {_cover('col', 'w', 'nw')} > 1e-9")
R.cte("reduced", "by_cell", "SELECT request_id, date, tr::INT AS row, tc::INT AS col, "
      + ", ".join(f"round_even(round(sum(wt * {b}) / sum(wt), 9), 0)::INT AS {b}" for b in RGB) + " FROM by_cell GROUP BY request_id, date, tr, tc")
R.cte("small_cuts", "reduced", f"""
SELECT request_id, date, count(*) FILTER (WHERE {_SIGNAL}) AS n, {_stretch_sql(f'FILTER (WHERE {_SIGNAL})')} FROM reduced GROUP BY request_id, date""")
R.cte("shown", "reduced small_cuts", "SELECT request_id, date, row, col, " + ", ".join(
    f"CASE WHEN n < 16 OR hi_{b} <= lo_{b} + 1e-6 THEN {b} WHEN {_SIGNAL} THEN floor(greatest(least(({b} - lo_{b}) / (lo_{b} + (hi_{b} - lo_{b}) - lo_{b}), 1), 0) * 255)::INT ELSE 0 END AS {b}" for b in RGB)
    + " FROM reduced JOIN small_cuts USING (request_id, date)")


def _preview(spark, sf):
    return Z.preview(R.scenes_8bit(spark, sf), R.headers(spark, sf), R.scene_boxes(spark, sf), RGB, RES_X, RES_Y, 20, ("date",))


@plan("preview_stats", R.sql("mosaic1 cropped reduced shown", ", st AS (" + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, request_id, date, '{b}' AS channel, {b} AS v FROM {rel}"
    for stage, rel in (("mosaic", "mosaic1"), ("cropped", "cropped"), ("reduced", "reduced"), ("display", "shown")) for b in RGB) + """)
SELECT stage, request_id, date::VARCHAR AS date, channel, count(*) AS pixels, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v <> 0) AS nonzero
FROM st GROUP BY stage, request_id, st.date, channel"""))
def preview_stats(spark, sf):
    out = _preview(spark, sf)[1]
    return out.select("stage", "request_id", day("date").alias("date"), "channel", "pixels", "min", "max", r6("mean").alias("mean"), "nonzero")


@plan("preview_pixels", R.sql("shown", "SELECT request_id, date::VARCHAR AS date, row, col, B4, B3, B2 FROM shown"))
def preview_pixels(spark, sf):
    return _preview(spark, sf)[0].withColumn("date", day("date"))


_BOX = {"lon_min": -94.5, "lat_min": 33.0, "lon_max": -91.0, "lat_max": 34.2}


def _near(centre: str, step: str, limit: str) -> str:
    return f"t.t BETWEEN greatest(floor({centre} - {step} - 0.5), 0) AND least(ceil({centre} + {step} - 0.5), {limit} - 1)"


R.cte("hits", "headers", f"""
SELECT * FROM headers WHERE lon_min <= {L(_BOX['lon_max'])} AND lon_max >= {L(_BOX['lon_min'])} AND lat_min <= {L(_BOX['lat_max'])} AND lat_max >= {L(_BOX['lat_min'])}""")
R.cte("frame", "hits", f"""
SELECT ceil(round(w / greatest(greatest(w, h) / 60::DOUBLE, 1), 6))::INT AS W, ceil(round(h / greatest(greatest(w, h) / 60::DOUBLE, 1), 6))::INT AS H FROM (
  SELECT ceil(round({L(_BOX['lon_max'] - _BOX['lon_min'])} / r, 6)) AS w, ceil(round({L(_BOX['lat_max'] - _BOX['lat_min'])} / r, 6)) AS h
  FROM (SELECT min(least(abs(dx), abs(dy))) AS r FROM hits))""")
R.cte("source", "px hits frame", f"""
SELECT p.tile || '@' || p.date AS scene, date_diff('day', DATE '2024-06-01', p.date) AS ord, p.B4, p.B3, p.B2, W, H,
  (x0 + (col + 0.5::DOUBLE) * dx - {L(_BOX['lon_min'])}) / ({L(_BOX['lon_max'] - _BOX['lon_min'])} / W) AS cx, dx / ({L(_BOX['lon_max'] - _BOX['lon_min'])} / W) AS sx,
  ({L(_BOX['lat_max'])} - (y0 + (row + 0.5::DOUBLE) * dy)) / ({L(_BOX['lat_max'] - _BOX['lat_min'])} / H) AS cy, -dy / ({L(_BOX['lat_max'] - _BOX['lat_min'])} / H) AS sy
FROM px p JOIN hits h USING (tile), frame""")
R.cte("spread_c", "source", f"""
SELECT s.*, t.t::INT AS col, 1 - abs(t.t + 0.5::DOUBLE - cx) / sx AS wc, t.t + 0.5::DOUBLE - cx >= -sx / 2 AND t.t + 0.5::DOUBLE - cx < sx / 2 AS oc FROM source s, range(60) t(t) WHERE {_near('cx', 'sx', 'W')}""")
R.cte("spread_r", "spread_c", f"""
SELECT s.*, t.t::INT AS row, 1 - abs(t.t + 0.5::DOUBLE - cy) / sy AS wr, t.t + 0.5::DOUBLE - cy >= -sy / 2 AND t.t + 0.5::DOUBLE - cy < sy / 2 AS o_r FROM spread_c s, range(60) t(t)
WHERE {_near('cy', 'sy', 'H')} AND (wc > 1e-9 OR oc)""")
R.cte("per_scene", "spread_r", "SELECT scene, ord, row, col, max(CASE WHEN oc AND o_r THEN 1 ELSE 0 END) AS ok, " + ", ".join(
    f"coalesce(floor(round(sum(greatest(wc, 0) * greatest(wr, 0) * {b}) FILTER (WHERE {b} > 0) / nullif(sum(greatest(wc, 0) * greatest(wr, 0)) FILTER (WHERE {b} > 0), 0), 6) + 0.5::DOUBLE), 0)::INT AS {b}" for b in RGB)
    + " FROM spread_r WHERE (wr > 1e-9 OR o_r) AND (B4 > 0 OR B3 > 0 OR B2 > 0) GROUP BY scene, ord, row, col")


@plan("overlay_scenes", R.sql("per_scene", "SELECT row, col, " + ", ".join(RGB) + """
FROM per_scene WHERE ok = 1 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY ord DESC, scene DESC) = 1"""))
def overlay_scenes(spark, sf):
    px = R.pixels(spark, sf, RGB).select(F.concat_ws("@", "tile", "date").alias("scene"), "tile", "date", "row", "col", *RGB)
    heads = px.filter("row = 0 and col = 0").select("scene", "tile", F.datediff("date", F.lit("2024-06-01")).alias("order")).join(R.headers(spark, sf), "tile")
    return Z.overlay_scenes(px.drop("tile", "date"), heads, RGB, _BOX, 60)[0]


# ---------------------------------------------------------------- chunks

@plan("chunk_positions", """
SELECT p_partkey, string_agg(s::VARCHAR, ',' ORDER BY s) AS starts FROM (
  SELECT p_partkey, k * 12 AS s FROM part, range(20) r(k) WHERE k * 12 <= greatest(p_size * 4 - 16, 0)
  UNION SELECT p_partkey, greatest(p_size * 4 - 16, 0) FROM part) GROUP BY p_partkey""")
def chunk_positions(spark, sf):
    p = R.table(spark, sf, "part")
    starts = F.array_sort(chunks.chunk_positions(F.col("p_size") * 4, 16, 12))
    return p.select("p_partkey", F.array_join(starts.cast("array<string>"), ",").alias("starts"))


R.cte("starts", "", "SELECT * FROM (VALUES (0), (3), (4)) v(s)")
R.cte("chunked", "chips starts", """
SELECT tile, date, a.s AS chunk_row, b.s AS chunk_col, row - a.s AS r, col - b.s AS c, B4, row, col
FROM chips JOIN starts a ON row BETWEEN a.s AND a.s + 3 JOIN starts b ON col BETWEEN b.s AND b.s + 3""")


def _chunked(spark, sf):
    return chunks.chunk_pixels(R.scenes_8bit(spark, sf, ("B4",)), _image_sizes(spark, sf), 4, 1, IMAGE)


@plan("chunk_pixels", R.sql("chunked", "SELECT tile, date::VARCHAR AS date, chunk_row, chunk_col, r, c, B4 FROM chunked"))
def chunk_pixels(spark, sf):
    return _chunked(spark, sf).select("tile", day("date").alias("date"), "chunk_row", "chunk_col", "r", "c", "B4")


@plan("pad_reflect", R.sql("chips", """
, f AS (SELECT q::INT AS q, CASE WHEN q % 14 < 8 THEN q % 14 ELSE 14 - q % 14 END AS s FROM range(20) r(q))
SELECT tile, date::VARCHAR AS date, a.q AS r, b.q AS c, B4, (a.q >= 8 OR b.q >= 8)::INT AS padded FROM chips JOIN f a ON a.s = row JOIN f b ON b.s = col"""))
def pad_reflect(spark, sf):
    one = chunks.chunk_pixels(R.scenes_8bit(spark, sf, ("B4",)), _image_sizes(spark, sf), 20, 0, IMAGE)
    return chunks.pad_chunks(one, 20).select("tile", day("date").alias("date"), "r", "c", "B4", bit("padded").alias("padded"))


def _w(p: str) -> str:
    return f"greatest(0.5::DOUBLE - 0.5::DOUBLE * cos({2.0 * 3.141592653589793!r}::DOUBLE * {p} / 3::DOUBLE), 1e-3)"


@plan("blend_chunks", R.sql("chunked", f"""
, w AS (SELECT tile, date::VARCHAR AS date, row, col, {_w('r')} * {_w('c')} AS w, (B4 + (chunk_row * 7 + chunk_col * 3) % 11) AS v FROM chunked)
SELECT tile, date, row, col, least(greatest(round_even(round(sum(w * v) / greatest(sum(w), 1e-6), 9), 0), 0), 255)::INT AS B4 FROM w GROUP BY ALL"""))
def blend_chunks(spark, sf):
    c = _chunked(spark, sf).withColumn("B4", F.col("B4") + (F.col("chunk_row") * 7 + F.col("chunk_col") * 3) % 11)
    return chunks.weighted_blend(c, 4, ["B4"], IMAGE).withColumn("date", day("date"))


@plan("stitch_chunks", R.sql("chips", "SELECT tile, date::VARCHAR AS date, row, col, B4 FROM chips"))
def stitch_chunks(spark, sf):
    c = chunks.chunk_pixels(R.scenes_8bit(spark, sf, ("B4",)), _image_sizes(spark, sf), 5, 0, IMAGE)
    return chunks.stitch_chunks(chunks.pad_chunks(c, 5), 5, 0, ["B4"], IMAGE).withColumn("date", day("date"))


# ---------------------------------------------------------------- fields

_FARM_BODY = """
reach AS (SELECT tile, label, row * 100 + col AS p, row * 100 + col AS root FROM mask WHERE label <> 0
  UNION SELECT m.tile, m.label, m.row * 100 + m.col, r.root FROM reach r JOIN mask m ON m.tile = r.tile AND m.label = r.label
    AND abs(m.row * 100 + m.col - r.p) IN (1, 100) AND abs(m.row - r.p // 100) + abs(m.col - r.p % 100) = 1),
comp AS (SELECT tile, label, p // 100 AS row, p % 100 AS col, min(root) AS root FROM reach GROUP BY ALL)"""


def _farm_sql(tail: str) -> str:
    text = R.sql("mask headers", "")
    return text.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _FARM_BODY.strip() + "\n" + tail


def _components(spark, sf):
    return components.connected_components(R.mask(spark, sf))


@plan("connected_components", _farm_sql("SELECT tile, label, row::INT AS row, col::INT AS col, (root // 100)::INT AS root_row, (root % 100)::INT AS root_col FROM comp"))
def connected_components(spark, sf):
    c = _components(spark, sf)
    shift = 1 << 31
    return c.select("tile", "label", "row", "col", F.floor(F.col("component") / shift).cast("int").alias("root_row"),
                    (F.col("component") % shift).cast("int").alias("root_col"))


_FARMS = """, f AS (SELECT tile, label, root, count(*) AS pixels, avg(row) AS cr, avg(col) AS cc FROM comp GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT f.*, round(h.x0 * 1000 + (cc + 0.5::DOUBLE) * 5::DOUBLE, 9) AS x, round(h.y0 * 1000 + (cr + 0.5::DOUBLE) * -5::DOUBLE, 9) AS y FROM f JOIN headers h USING (tile)),
k AS (SELECT *, trunc(x)::BIGINT || '_' || trunc(y)::BIGINT AS farm_id FROM g),
kept AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY tile, label, farm_id ORDER BY root DESC) = 1)
"""


def _farms(spark, sf):
    h = R.headers(spark, sf).select("tile", (F.col("x0") * 1000).alias("x0"), (F.col("y0") * 1000).alias("y0"), F.lit(5.0).alias("dx"), F.lit(-5.0).alias("dy"))
    c = _components(spark, sf)
    return c, components.farms(c, h, 3)


@plan("farms", _farm_sql(_FARMS.strip() + """
SELECT tile, label, farm_id, pixels, round(cr, 6) AS centre_row, round(cc, 6) AS centre_col FROM kept"""))
def farms(spark, sf):
    out = _farms(spark, sf)[1]
    return out.select("tile", "label", "farm_id", "pixels", r6("centre_row").alias("centre_row"), r6("centre_col").alias("centre_col"))


@plan("farm_date_means", _farm_sql(_FARMS.strip() + f""", crops AS ({R.CTES['crops'][1]}),
v AS (SELECT k.tile, c.crop, k.farm_id, p.date, p.B2 / 10000::DOUBLE AS b, p.B4 / 10000::DOUBLE AS r, p.B8 / 10000::DOUBLE AS n, p.B11 / 10000::DOUBLE AS s
  FROM kept k JOIN comp m ON m.tile = k.tile AND m.label = k.label AND m.root = k.root JOIN px p ON p.tile = m.tile AND p.row = m.row AND p.col = m.col JOIN crops c ON c.label = k.label)
SELECT tile, crop, farm_id, date::VARCHAR AS date, round(avg(greatest(least((n - r) / (n + r + 1e-10), 1), -1)), 6) AS ndvi,
  round(avg(greatest(least((n - s) / (n + s + 1e-10), 1), -1)), 6) AS ndwi,
  round(avg(greatest(least(2.5::DOUBLE * (n - r) / (n + 6 * r - 7.5::DOUBLE * b + 1 + 1e-10::DOUBLE), 1), -1)), 6) AS evi FROM v GROUP BY tile, crop, farm_id, v.date"""))
def farm_date_means(spark, sf):
    c, found = _farms(spark, sf)
    out = O.farm_date_means(R.pixels(spark, sf), components.farm_pixels(c, found, R.crops(spark)))
    return out.select("tile", "crop", "farm_id", day("date").alias("date"), *[r6(c).alias(c) for c in ("ndvi", "ndwi", "evi")])


# ---------------------------------------------------------------- models

def _mean_model(path):
    """Stand-in model for the sample tables: position of the mean signal."""
    return 0.25 if "Corn" in path else 0.5


def _mean_predict(model, x):
    import numpy as np

    m = x[:, 0, :].astype(np.float64).mean(axis=1)
    return np.stack([model + m / 4, model + m / 2], axis=1)


@plan("score_records", R.sql("recs rbins", """
, grid AS (SELECT r.*, bin FROM recs r, range(73) x(bin)),
v AS (SELECT g.year, g.tile, g.crop, g.num_observations,
    (CASE WHEN o.v IS NOT NULL THEN o.v WHEN l.bin IS NULL OR n.bin IS NULL THEN 0 ELSE (n.v - l.v) / (n.bin - l.bin) * (g.bin - l.bin) + l.v END::FLOAT)::DOUBLE AS y
  FROM grid g LEFT JOIN rbins o ON g.year = o.year AND g.tile = o.tile AND g.crop = o.crop AND g.bin = o.bin
  ASOF LEFT JOIN rbins l ON g.year = l.year AND g.tile = l.tile AND g.crop = l.crop AND g.bin >= l.bin
  ASOF LEFT JOIN rbins n ON g.year = n.year AND g.tile = n.tile AND g.crop = n.crop AND g.bin <= n.bin),
m AS (SELECT year, tile, crop, any_value(num_observations) AS n, avg(y) AS m, CASE crop WHEN 'Corn' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS base FROM v WHERE crop IN ('Corn', 'Rice') GROUP BY ALL),
d AS (SELECT *, least(greatest(round_even((base + m / 4) * 366, 0), 1), 366)::INT AS s, least(greatest(round_even((base + m / 2) * 366, 0), 1), 366)::INT AS e FROM m)
SELECT year, tile, crop, s AS pred_start_doy, greatest(s, e) AS pred_end_doy, n::INT AS num_observations, CASE crop WHEN 'Corn' THEN 12.5::DOUBLE ELSE 14::DOUBLE END AS model_test_mae_days FROM d"""))
def score_records(spark, sf):
    from fieldtide.operators import features
    from fieldtide.plans.season_plans import _flagged

    records = features.build_records(_flagged(spark, sf), "ndvi_only", R.windows(spark), round4=True)
    registry = spark.createDataFrame([("Corn", 12.5), ("Rice", 14.0)], "crop string, test_mae_days double")
    registry = registry.withColumn("model_path", F.concat(F.lit("models/"), T.safe_model_name(F.col("crop"))))
    ready, _ = scoring.score_ready(records, registry)
    return scoring.score_records(ready, registry, _mean_model, _mean_predict)


@plan("score_ready", R.sql("predictions", """
SELECT 'ready' AS kind, crop, count(*) AS records FROM predictions WHERE crop IN ('Corn', 'Rice') GROUP BY crop
UNION ALL SELECT 'skipped', crop, count(*) FROM predictions WHERE crop NOT IN ('Corn', 'Rice') GROUP BY crop"""))
def score_ready(spark, sf):
    registry = spark.createDataFrame([("Corn",), ("Rice",)], "crop string")
    ready, skipped = scoring.score_ready(R.predictions(spark, sf), registry)
    counts = ready.groupBy("crop").agg(F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit("ready"))
    return counts.unionByName(skipped.withColumn("kind", F.lit("skipped"))).select("kind", "crop", "records")


def _invert(_model, x):
    return 255.0 - x


@plan("score_chunks", R.sql("chips", "SELECT tile, date::VARCHAR AS date, row, col, (255 - B4)::INT AS B4 FROM chips"))
def score_chunks(spark, sf):
    padded = chunks.pad_chunks(_chunked(spark, sf), 4)
    arrays = chunks.chunk_arrays(padded, ["B4"], IMAGE)
    scored = scoring.score_chunks(arrays, lambda: None, _invert, 4, 1, IMAGE, out_bands=("B4",))
    return chunks.stitch_chunks(scored, 4, 1, ["B4"], IMAGE).withColumn("date", day("date"))
