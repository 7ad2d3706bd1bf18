"""Series plans: filling, smoothing, detection, votes, sowing, features."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from fieldtide.functions import dates as D
from fieldtide.operators import features, observations as O, seasons as S, voting as V
from fieldtide.plans import relations as R
from fieldtide.plans.registry import bit, day, num, plan, r6

K = R.K
KEY = R.LONG_KEY


@plan("gap_fill", R.sql("filled", f"SELECT {K}, i, n_valid, round(filled, 6) AS filled FROM filled"))
def gap_fill(spark, sf):
    out = S.fill_gaps(R.long_observations(spark, sf), KEY)
    return out.select(*KEY, "i", "n_valid", r6("filled").alias("filled"))


def _smoothed(spark, sf):
    return S.savgol(S.fill_gaps(R.long_observations(spark, sf), KEY), KEY)


@plan("savgol_smooth", R.sql("smoothed", f"SELECT {K}, i, round(smooth, 6) AS smooth FROM smoothed"))
def savgol_smooth(spark, sf):
    return _smoothed(spark, sf).select(*KEY, "i", r6("smooth").alias("smooth"))


def _sloped(spark, sf):
    return S.gradient(_smoothed(spark, sf), KEY)


@plan("gradient", R.sql("slopes", f"SELECT {K}, i, round(slope, 6) AS slope FROM slopes"))
def gradient(spark, sf):
    return _sloped(spark, sf).select(*KEY, "i", r6("slope").alias("slope"))


@plan("peak", R.sql("rows1", f"""
SELECT {K}, any_value(peak_i)::BIGINT AS peak_i, round(any_value(peak_y), 6) AS peak_y, any_value(boundary)::INT AS boundary
FROM rows1 GROUP BY ALL"""))
def peak(spark, sf):
    rows = S.find_peak(_smoothed(spark, sf), KEY)
    return rows.groupBy(*KEY).agg(
        F.first("peak_i").cast("bigint").alias("peak_i"), F.first(r6("peak_y")).alias("peak_y"), F.first(bit("boundary")).alias("boundary"))


def _declined(spark, sf):
    return S.decline_and_minimum(S.find_peak(_sloped(spark, sf), KEY), KEY)


@plan("steepest_decline", R.sql("picks", f"SELECT {K}, start_i::BIGINT AS start_i FROM picks"))
def steepest_decline(spark, sf):
    return _declined(spark, sf).groupBy(*KEY).agg(F.first("start_i").cast("bigint").alias("start_i"))


@plan("post_peak_min", R.sql("picks", f"SELECT {K}, end_i::BIGINT AS end_i FROM picks"))
def post_peak_min(spark, sf):
    return _declined(spark, sf).groupBy(*KEY).agg(F.first("end_i").cast("bigint").alias("end_i"))


@plan("persistent_below", R.sql("rows3", f"""
SELECT {K}, any_value(retry)::INT AS retry, coalesce(any_value(run_i), -1)::BIGINT AS run_i, coalesce(any_value(steep_i), -1)::BIGINT AS steep_i
FROM rows3 GROUP BY ALL"""))
def persistent_below(spark, sf):
    rows = S.persistent_below(_declined(spark, sf), KEY)
    return rows.groupBy(*KEY).agg(
        F.first(bit("retry")).alias("retry"), F.first(num("run_i")).alias("run_i"), F.first(num("steep_i")).alias("steep_i"))


@plan("detect_harvest", R.sql("detected", f"""
SELECT {K}, coalesce(s_date::VARCHAR, '') AS start, coalesce(e_date::VARCHAR, '') AS "end", rule AS start_rule, n::INT AS n, n_valid::INT AS n_valid
FROM detected"""))
def detect_harvest(spark, sf):
    out = S.detect_harvest(R.long_observations(spark, sf), KEY, daily=True)
    return out.select(*KEY, day("start").alias("start"), day("end").alias("end"), "start_rule", "n", "n_valid")


@plan("insufficient_series", R.sql("long", f"""
SELECT {K}, count(y) AS points FROM long GROUP BY ALL HAVING count(y) < 25"""))
def insufficient_series(spark, sf):
    long = R.long_observations(spark, sf)
    kept = S.min_points(long, KEY, 25).select(*KEY).distinct()
    return long.join(kept, KEY, "left_anti").groupBy(*KEY).agg(F.count("y").alias("points"))


# Votes take the three indices of one series as candidates.
R.cte("cands", "detected windows", """
SELECT d.year, d.tile, d.crop, d.index_name AS source, d.s_date, d.e_date, d.rule, d.first_date, d.last_date,
  (d.year::VARCHAR || '-' || w.start_md)::DATE AS t_start, (d.year::VARCHAR || '-' || w.end_md)::DATE AS t_end
FROM detected d LEFT JOIN windows w USING (crop)""")
R.cte("major", "cands", """
SELECT year, tile, crop, coalesce((list(e_date ORDER BY votes DESC, e_date DESC) FILTER (WHERE e_date IS NOT NULL))[1], max(last_date)) AS chosen,
  max(t_end) AS t_end
FROM (SELECT year, tile, crop, e_date, count(*) AS votes, max(last_date) AS last_date, max(t_end) AS t_end FROM cands GROUP BY year, tile, crop, e_date)
GROUP BY year, tile, crop""")
R.cte("closest", "cands", """
SELECT year, tile, crop, any_value(t_start) AS t_start, min(first_date) AS first_date,
  (list({'d': s_date, 's': source, 'r': rule} ORDER BY coalesce(abs(date_diff('day', t_start, s_date)), 0), s_date,
    CASE WHEN contains(lower(rule), 'steepest_decline_') THEN 0 WHEN starts_with(lower(rule), 'threshold') THEN 1 ELSE 2 END, source)
    FILTER (WHERE s_date IS NOT NULL))[1] AS best
FROM cands GROUP BY year, tile, crop""")
R.cte("starts", "closest", """
SELECT year, tile, crop, CASE WHEN best IS NULL THEN coalesce(t_start, first_date) ELSE best.d END AS chosen,
  CASE WHEN best IS NULL THEN 'FALLBACK' ELSE best.s END AS source,
  CASE WHEN best IS NULL THEN 'no_valid_dates_all_sources' ELSE best.r END AS rule,
  CASE WHEN t_start IS NULL THEN NULL WHEN best IS NULL THEN 0 ELSE abs(date_diff('day', t_start, best.d)) END AS div_days
FROM closest""")
R.cte("ends", "starts major cands", """
SELECT s.year, s.tile, s.crop, s.chosen AS start, s.source, s.rule, s.div_days AS div_start, m.chosen AS voted_end,
  abs(date_diff('day', m.t_end, m.chosen)) AS div_end,
  CASE WHEN m.chosen < s.chosen THEN coalesce(c.later, CASE WHEN c.last_date >= s.chosen THEN c.last_date ELSE s.chosen END) ELSE m.chosen END AS fixed_end
FROM starts s JOIN major m USING (year, tile, crop)
JOIN (SELECT x.year, x.tile, x.crop, max(x.e_date) FILTER (WHERE x.e_date >= y.chosen) AS later, max(x.last_date) AS last_date
  FROM cands x JOIN starts y USING (year, tile, crop) GROUP BY ALL) c USING (year, tile, crop)""")


def _candidates(spark, sf):
    found = S.detect_harvest(R.long_observations(spark, sf), KEY, daily=True)
    rows = found.join(R.windows(spark), "crop", "left")
    return rows.withColumns({
        "t_start": D.month_day_in_year(F.col("year"), F.col("start_md")), "t_end": D.month_day_in_year(F.col("year"), F.col("end_md"))})


@plan("majority_vote", R.sql("major", """
SELECT year, tile, crop, chosen::VARCHAR AS chosen, coalesce(abs(date_diff('day', t_end, chosen)), -1)::BIGINT AS div_days FROM major"""))
def majority_vote(spark, sf):
    out = V.majority_vote(_candidates(spark, sf), R.SERIES, "end", "end", "last_date", "t_end")
    return out.select(*R.SERIES, day("chosen").alias("chosen"), num("div_days").alias("div_days"))


@plan("closest_vote", R.sql("starts", """
SELECT year, tile, crop, chosen::VARCHAR AS chosen, source, rule, coalesce(div_days, -1)::BIGINT AS div_days FROM starts"""))
def closest_vote(spark, sf):
    out = V.closest_vote(_candidates(spark, sf), R.SERIES, "start", "start", "index_name", "start_rule", "t_start", "first_date")
    return out.select(*R.SERIES, day("chosen").alias("chosen"), "source", "rule", num("div_days").alias("div_days"))


@plan("repair_end", R.sql("ends", """
SELECT year, tile, crop, fixed_end::VARCHAR AS "end", (fixed_end <> voted_end)::INT AS repaired FROM ends"""))
def repair_end(spark, sf):
    c = _candidates(spark, sf)
    sources = F.collect_list(F.struct(F.col("index_name").alias("source"), F.col("start").alias("date"), F.col("start_rule").alias("rule")))
    per_key = c.groupBy(*R.SERIES).agg(  # three rows per key, one per index
        sources.alias("s"), F.collect_list("end").alias("e"), F.min("first_date").alias("f"), F.max("last_date").alias("l"),
        F.first("t_start").alias("t"))
    rows = per_key.withColumns({
        "start": V.closest(F.col("s"), F.col("t"), F.col("f"), "start")["date"], "end0": V.majority(F.col("e"), F.col("l"), "end")})
    rows = rows.withColumn("end", V.repair_end(F.col("start"), F.col("end0"), F.col("e"), F.col("l")))
    return rows.select(*R.SERIES, day("end").alias("end"), bit(F.col("end") != F.col("end0")).alias("repaired"))


@plan("greenup", R.sql("greenups", f"SELECT {K}, coalesce(greenup::VARCHAR, '') AS greenup FROM greenups"))
def greenup(spark, sf):
    rows = _smoothed(spark, sf).withColumn("smooth", F.when((F.col("n") >= 3) & (F.col("n_valid") >= 11), F.col("smooth")))
    rows = rows.join(R.seeding(spark), "crop").withColumns({
        "ws": D.month_day_in_year(F.col("year"), F.col("window_start")), "we": D.month_day_in_year(F.col("year"), F.col("window_end"))})
    return S.find_greenup(rows, KEY, "ws", "we").select(*KEY, day("greenup").alias("greenup"))


R.cte("sown", "greenups seeding", """
SELECT year, tile, crop, any_value(offset_days) AS offset_days, any_value(window_start) AS window_start, any_value(window_end) AS window_end,
  max(greenup) FILTER (WHERE index_name = 'NDVI') AS gn, max(greenup) FILTER (WHERE index_name = 'EVI') AS ge
FROM greenups JOIN seeding USING (crop) GROUP BY year, tile, crop""")
_SOWN = """coalesce(coalesce(gn, ge)::VARCHAR, '') AS greenup,
  CASE WHEN year(coalesce(gn, ge) - offset_days) = year THEN (coalesce(gn, ge) - offset_days)::VARCHAR ELSE '' END AS seeding,
  CASE WHEN gn IS NOT NULL THEN 'NDVI' WHEN ge IS NOT NULL THEN 'EVI' ELSE '' END AS greenup_source,
  CASE WHEN coalesce(gn, ge) IS NOT NULL THEN 'sustained_rise_next3_count2_delta0.01_total0.03' ELSE '' END AS greenup_rule"""


@plan("seeding", R.sql("sown obs", f"""
SELECT o.year, o.tile, o.crop, {_SOWN}, coalesce(offset_days, -1)::BIGINT AS offset_days
FROM (SELECT DISTINCT year, tile, crop FROM obs) o LEFT JOIN sown USING (year, tile, crop)"""))
def seeding(spark, sf):
    out = S.estimate_seeding(R.observations(spark, sf), R.SERIES, R.seeding(spark), daily=True)
    return out.select(*R.SERIES, day("greenup").alias("greenup"), day("seeding").alias("seeding"), "greenup_source",
                      "greenup_rule", num("offset_days").alias("offset_days"))


R.cte("events_", "ends windows detected sown", f"""
SELECT e.year, e.tile, e.crop, e.start, e.fixed_end, e.source, e.rule, e.div_start, e.div_end,
  CASE WHEN w.crop IS NULL THEN 0::DOUBLE ELSE coalesce(
    greatest(date_diff('day', greatest(e.start, (e.year::VARCHAR || '-' || w.start_md)::DATE), least(e.fixed_end, (e.year::VARCHAR || '-' || w.end_md)::DATE)), 0)::DOUBLE
    / nullif(date_diff('day', least(e.start, (e.year::VARCHAR || '-' || w.start_md)::DATE), greatest(e.fixed_end, (e.year::VARCHAR || '-' || w.end_md)::DATE)), 0), 0) END AS iou,
  {_SOWN.replace('year(coalesce(gn, ge) - offset_days) = year', 'year(coalesce(gn, ge) - offset_days) = e.year')}
FROM ends e LEFT JOIN windows w USING (crop) LEFT JOIN sown USING (year, tile, crop)
WHERE EXISTS (SELECT 1 FROM detected d WHERE d.year = e.year AND d.tile = e.tile AND d.crop = e.crop AND d.index_name = 'NDVI' AND d.n_valid >= 11)""")


def _events(spark, sf):
    return V.season_events(R.observations(spark, sf), R.SERIES, R.windows(spark), R.seeding(spark), daily=True)


@plan("season_events", R.sql("events_", """
SELECT year, tile, crop, start::VARCHAR AS start, fixed_end::VARCHAR AS "end", source, rule AS start_rule,
  coalesce(div_start, -1)::BIGINT AS div_start, coalesce(div_end, -1)::BIGINT AS div_end, round(iou, 6) AS iou,
  greenup, seeding, greenup_source, greenup_rule FROM events_"""))
def season_events(spark, sf):
    return _events(spark, sf).select(
        *R.SERIES, day("start").alias("start"), day("end").alias("end"), "source", "start_rule", num("div_start").alias("div_start"),
        num("div_end").alias("div_end"), r6("iou").alias("iou"), day("greenup").alias("greenup"), day("seeding").alias("seeding"),
        "greenup_source", "greenup_rule")


@plan("harvest_iou", R.sql("predictions", """
, p AS (SELECT year, tile, crop, make_date(year, 1, 1) + (pred_start_doy - 1) AS s, make_date(year, 1, 1) + (pred_end_doy - 1) AS e,
  make_date(2019, 7, 31) AS a, make_date(2019, 10, 15) AS b, make_date(year, 7, 31) AS c, make_date(year, 10, 15) AS d FROM predictions)
SELECT year, tile, crop, round(greatest(date_diff('day', greatest(s, a), least(e, b)), 0)::DOUBLE / date_diff('day', least(s, a), greatest(e, b)), 6) AS iou_fixed,
  round(greatest(date_diff('day', greatest(s, c), least(e, d)), 0)::DOUBLE / date_diff('day', least(s, c), greatest(e, d)), 6) AS iou_year FROM p"""))
def harvest_iou(spark, sf):
    p = R.predictions(spark, sf)
    y = F.col("year")
    s, e = D.doy_to_date(y, F.col("pred_start_doy")), D.doy_to_date(y, F.col("pred_end_doy"))
    ws, we = F.lit("07-31"), F.lit("10-15")
    return p.select(*R.SERIES, r6(D.harvest_iou(s, e, ws, we, F.lit(2019))).alias("iou_fixed"), r6(D.harvest_iou(s, e, ws, we, y)).alias("iou_year"))


R.cte("marks", "events_", """
SELECT DISTINCT year, tile, crop, date FROM (
  SELECT year, tile, crop, start AS date FROM events_ UNION ALL SELECT year, tile, crop, fixed_end FROM events_
  UNION ALL SELECT year, tile, crop, try_cast(nullif(greenup, '') AS DATE) FROM events_ UNION ALL SELECT year, tile, crop, try_cast(nullif(seeding, '') AS DATE) FROM events_)
WHERE date IS NOT NULL""")
R.cte("timeline", "obs events_ marks", """
SELECT * FROM (
  SELECT year, tile, crop, date, o.ndvi, o.ndwi, o.evi, CASE WHEN date = e.start THEN 'Start' WHEN date = e.fixed_end THEN 'End' ELSE '' END AS harvest,
    CASE WHEN date::VARCHAR = e.greenup AND date::VARCHAR = e.seeding THEN 'GreenupStart;EstimatedSeedingDate' WHEN date::VARCHAR = e.greenup THEN 'GreenupStart'
      WHEN date::VARCHAR = e.seeding THEN 'EstimatedSeedingDate' ELSE '' END AS seeding_event, e.rule, e.div_start, e.div_end, e.iou, e.greenup_source, e.greenup_rule
  FROM obs o FULL JOIN marks m USING (year, tile, crop, date) JOIN events_ e USING (year, tile, crop))
WHERE ndvi IS NOT NULL OR ndwi IS NOT NULL OR evi IS NOT NULL OR harvest <> '' OR seeding_event <> ''""")


def _timeline(spark, sf):
    return O.timeline_with_events(R.observations(spark, sf), _events(spark, sf), R.SERIES)


@plan("season_timeline", R.sql("timeline seeding", """
, t AS (SELECT timeline.*, s.offset_days, s.window_start, s.window_end FROM timeline LEFT JOIN seeding s USING (crop))
SELECT year, tile, crop, date::VARCHAR AS date, round(coalesce(ndvi, -9), 6) AS ndvi, round(coalesce(ndwi, -9), 6) AS ndwi, round(coalesce(evi, -9), 6) AS evi, harvest, seeding_event,
  CASE WHEN harvest = 'Start' THEN rule ELSE '' END AS start_rule,
  CASE WHEN harvest = 'Start' THEN coalesce(div_start, -1) ELSE -1 END::BIGINT AS div_start,
  CASE WHEN harvest = 'End' THEN coalesce(div_end, -1) ELSE -1 END::BIGINT AS div_end,
  round(CASE WHEN harvest = 'Start' THEN coalesce(iou, -9) ELSE -9 END, 6) AS iou,
  CASE WHEN seeding_event <> '' THEN greenup_source ELSE '' END AS greenup_source,
  CASE WHEN seeding_event <> '' THEN greenup_rule ELSE '' END AS greenup_rule,
  CASE WHEN seeding_event <> '' THEN coalesce(offset_days, -1) ELSE -1 END::BIGINT AS seeding_offset_days,
  CASE WHEN seeding_event <> '' THEN coalesce(window_start, '') ELSE '' END AS seeding_window_start,
  CASE WHEN seeding_event <> '' THEN coalesce(window_end, '') ELSE '' END AS seeding_window_end FROM t"""))
def season_timeline(spark, sf):
    t = _timeline(spark, sf)
    miss = lambda c: r6(F.coalesce(c, F.lit(-9.0))).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    whole = lambda c: num(c).alias(c)
    return t.select(*R.SERIES, day("date").alias("date"), miss("ndvi"), miss("ndwi"), miss("evi"), "harvest", "seeding_event",
                    text("start_rule"), whole("div_start"), whole("div_end"), miss("iou"), text("greenup_source"), text("greenup_rule"),
                    whole("seeding_offset_days"), text("seeding_window_start"), text("seeding_window_end"))


@plan("farm_season_summary", R.sql("timeline", """
SELECT year, tile, crop,
  coalesce(max(date) FILTER (WHERE harvest = 'Start')::VARCHAR, '') AS harvest_start, coalesce(max(date) FILTER (WHERE harvest = 'End')::VARCHAR, '') AS harvest_end,
  coalesce(max(date) FILTER (WHERE contains(seeding_event, 'GreenupStart'))::VARCHAR, '') AS greenup_start,
  coalesce(max(date) FILTER (WHERE contains(seeding_event, 'EstimatedSeedingDate'))::VARCHAR, '') AS estimated_seeding_date,
  coalesce(max(greenup_source) FILTER (WHERE seeding_event <> ''), '') AS seeding_source
FROM timeline GROUP BY ALL"""))
def farm_season_summary(spark, sf):
    rows = O.row_numbers(_timeline(spark, sf), R.SERIES)
    out = O.farm_season_summary(rows, R.SERIES)
    return out.select(*R.SERIES, *[day(c).alias(c) for c in ("harvest_start", "harvest_end", "greenup_start", "estimated_seeding_date")],
                      F.coalesce("seeding_source", F.lit("")).alias("seeding_source"))


@plan("season_summary_rows", R.sql("timeline", """
SELECT crop AS "Crop", tile, date::VARCHAR AS "Date", coalesce(printf('%.4f', ndvi), '') AS "NDVI", harvest AS "Harvest", seeding_event AS "SeedingEvent" FROM timeline"""))
def season_summary_rows(spark, sf):
    from fieldtide.sources.sinks import season_summary_rows as layout

    return layout(_timeline(spark, sf)).select("Crop", "tile", "Date", "NDVI", "Harvest", "SeedingEvent")


@plan("dense_timeline", R.sql("obs", """
, d AS (SELECT DISTINCT year, tile, date FROM obs), c AS (SELECT DISTINCT year, tile, crop FROM obs)
SELECT year, tile, crop, date::VARCHAR AS date, round(coalesce(o.ndvi, -9), 6) AS ndvi
FROM d JOIN c USING (year, tile) LEFT JOIN obs o USING (year, tile, crop, date)"""))
def dense_timeline(spark, sf):
    out = O.dense_timeline(R.observations(spark, sf))
    return out.select(*R.SERIES, day("date").alias("date"), r6(F.coalesce("ndvi", F.lit(-9.0))).alias("ndvi"))


# ---------------------------------------------------------------- features

R.cte("fobs", "obs", """
SELECT year, tile, crop, date, dayofyear(date) AS doy, ndvi, ndwi, evi FROM obs""")
R.cte("fbins", "fobs", """
SELECT year, tile, crop, least((doy - 1) // 5, 72) AS bin, avg(ndvi) AS ndvi, avg(ndwi) AS ndwi, avg(evi) AS evi,
  ((avg(ndvi) IS NOT NULL)::INT + (avg(ndwi) IS NOT NULL)::INT + (avg(evi) IS NOT NULL)::INT) / 3::DOUBLE AS valid_fraction
FROM fobs GROUP BY ALL""")


def _binned(spark, sf):
    obs = R.observations(spark, sf).withColumn("doy", F.dayofyear("date"))
    return features.bin_features(obs, R.SERIES, ("ndvi", "ndwi", "evi"))


@plan("bin_features", R.sql("fbins", """
SELECT year, tile, crop, bin, round(coalesce(ndvi, -9), 6) AS ndvi, round(coalesce(ndwi, -9), 6) AS ndwi, round(coalesce(evi, -9), 6) AS evi,
  round(valid_fraction, 6) AS valid_fraction FROM fbins"""))
def bin_features(spark, sf):
    b = _binned(spark, sf)
    return b.select(*R.SERIES, "bin", *[r6(F.coalesce(c, F.lit(-9.0))).alias(c) for c in ("ndvi", "ndwi", "evi")], r6("valid_fraction").alias("valid_fraction"))


def _line_sql(feature: str, channel: int) -> str:
    return f"""SELECT year, tile, crop, {channel} AS channel, g.bin, CASE
    WHEN o.v IS NOT NULL THEN o.v WHEN l.bin IS NULL OR r.bin IS NULL THEN 0
    ELSE ((r.v - l.v) / (r.bin - l.bin) * (g.bin - l.bin) + l.v)::FLOAT END::FLOAT AS value
  FROM (SELECT year, tile, crop, bin FROM (SELECT DISTINCT year, tile, crop FROM fbins), range(73) x(bin)) g
  LEFT JOIN (SELECT year, tile, crop, bin, {feature}::FLOAT::DOUBLE AS v FROM fbins WHERE {feature} IS NOT NULL) o USING (year, tile, crop, bin)
  ASOF LEFT JOIN (SELECT year, tile, crop, bin, {feature}::FLOAT::DOUBLE AS v FROM fbins WHERE {feature} IS NOT NULL) l
    ON g.year = l.year AND g.tile = l.tile AND g.crop = l.crop AND g.bin >= l.bin
  ASOF LEFT JOIN (SELECT year, tile, crop, bin, {feature}::FLOAT::DOUBLE AS v FROM fbins WHERE {feature} IS NOT NULL) r
    ON g.year = r.year AND g.tile = r.tile AND g.crop = r.crop AND g.bin <= r.bin"""


for _c, _f in enumerate(("ndvi", "ndwi", "evi")):
    R.cte(f"line{_c}", "fbins", _line_sql(_f, _c).replace("SELECT year, tile, crop, " + str(_c), "SELECT g.year, g.tile, g.crop, " + str(_c), 1))
R.cte("tensor", "line0 line1 line2 fbins", """
SELECT * FROM line0 UNION ALL SELECT * FROM line1 UNION ALL SELECT * FROM line2
UNION ALL SELECT year, tile, crop, 3, x.bin, coalesce(f.valid_fraction, 0)::FLOAT
  FROM (SELECT year, tile, crop, bin FROM (SELECT DISTINCT year, tile, crop FROM fbins), range(73) r(bin)) x LEFT JOIN fbins f USING (year, tile, crop, bin)""")


@plan("interpolate_inside", R.sql("line0 fbins", """
SELECT year, tile, crop, bin::INT AS bin, round(value::DOUBLE, 6) AS value FROM line0
WHERE EXISTS (SELECT 1 FROM fbins f WHERE f.year = line0.year AND f.tile = line0.tile AND f.crop = line0.crop AND f.ndvi IS NOT NULL)"""))
def interpolate_inside(spark, sf):
    rows = _binned(spark, sf).select(*R.SERIES, "bin", F.col("ndvi").alias("value"))
    return features.interpolate_inside(rows, R.SERIES).select(*R.SERIES, "bin", r6("value").alias("value"))


def _flat(x):
    return F.posexplode(F.flatten(x))


@plan("feature_tensor", R.sql("tensor", """
SELECT year, tile, crop, (channel * 73 + bin)::INT AS pos, round(value::DOUBLE, 6) AS value FROM tensor"""))
def feature_tensor(spark, sf):
    out = features.assemble_tensor(_binned(spark, sf), R.SERIES, ("ndvi", "ndwi", "evi"))
    return out.select(*R.SERIES, _flat("x").alias("pos", "v")).select(*R.SERIES, "pos", r6("v").alias("value"))


R.cte("flagged", "obs", """
SELECT year, tile, crop, date, ndvi, ndwi, evi, CASE WHEN rn % 7 = 2 AND rn < n / 2 THEN 'Start' WHEN rn % 5 = 3 AND rn > n / 2 THEN 'End' ELSE '' END AS harvest, rn AS row_no
FROM (SELECT *, row_number() OVER (PARTITION BY year, tile, crop ORDER BY date) AS rn, count(*) OVER (PARTITION BY year, tile, crop) AS n FROM obs)""")


def _flagged(spark, sf):
    w = W.partitionBy(*R.SERIES)
    rows = R.observations(spark, sf).withColumns({"row_no": F.row_number().over(w.orderBy("date")), "_n": F.count(F.lit(1)).over(w)})
    rn, half = F.col("row_no"), F.col("_n") / 2
    flag = F.when((rn % 7 == 2) & (rn < half), "Start").when((rn % 5 == 3) & (rn > half), "End").otherwise("")
    return rows.withColumn("harvest", flag).drop("_n")


R.cte("labelled", "flagged", """
SELECT year, tile, crop, dayofyear(max(date) FILTER (WHERE harvest = 'Start')) AS start_doy, dayofyear(max(date) FILTER (WHERE harvest = 'End')) AS end_doy
FROM flagged GROUP BY ALL""")


@plan("labels_from_rows", R.sql("labelled", """
SELECT year, tile, crop, coalesce(start_doy, -1)::BIGINT AS start_doy, coalesce(end_doy, -1)::BIGINT AS end_doy FROM labelled"""))
def labels_from_rows(spark, sf):
    rows = _flagged(spark, sf).withColumn("doy", F.dayofyear("date"))
    out = features.labels_from_rows(rows, R.SERIES)
    return out.select(*R.SERIES, num("start_doy").alias("start_doy"), num("end_doy").alias("end_doy"))


R.cte("inwin", "flagged windows", """
SELECT year, tile, crop, date, round(ndvi, 4) AS ndvi FROM flagged LEFT JOIN windows USING (crop)
WHERE start_md IS NULL OR month(date) * 100 + day(date) BETWEEN replace(start_md, '-', '')::INT AND replace(end_md, '-', '')::INT""")
R.cte("recs", "inwin labelled", """
SELECT year, tile, crop, any_value(start_doy) AS start_doy, any_value(end_doy) AS end_doy, count(ndvi) AS num_observations
FROM inwin JOIN labelled USING (year, tile, crop) GROUP BY ALL
HAVING count(ndvi) >= 2 AND any_value(start_doy) IS NOT NULL AND any_value(end_doy) IS NOT NULL AND any_value(start_doy) <= any_value(end_doy)""")
R.cte("rbins", "inwin", """
SELECT year, tile, crop, least((dayofyear(date) - 1) // 5, 72) AS bin, avg(ndvi)::FLOAT::DOUBLE AS v FROM inwin WHERE ndvi IS NOT NULL GROUP BY ALL""")


@plan("build_records", R.sql("recs rbins", """
, grid AS (SELECT r.*, bin FROM recs r, range(73) x(bin))
SELECT g.year, g.tile, g.crop, g.start_doy::INT AS start_doy, g.end_doy::INT AS end_doy, g.num_observations::INT AS num_observations, 'ndvi_only' AS feature_set, g.bin::INT AS bin,
  round((CASE WHEN o.v IS NOT NULL THEN o.v WHEN l.bin IS NULL OR n.bin IS NULL THEN 0 ELSE (n.v - l.v) / (n.bin - l.bin) * (g.bin - l.bin) + l.v END::FLOAT)::DOUBLE, 6) AS ndvi,
  (o.v IS NOT NULL)::INT::DOUBLE AS valid_fraction
FROM grid g LEFT JOIN rbins o ON g.year = o.year AND g.tile = o.tile AND g.crop = o.crop AND g.bin = o.bin
ASOF LEFT JOIN rbins l ON g.year = l.year AND g.tile = l.tile AND g.crop = l.crop AND g.bin >= l.bin
ASOF LEFT JOIN rbins n ON g.year = n.year AND g.tile = n.tile AND g.crop = n.crop AND g.bin <= n.bin"""))
def build_records(spark, sf):
    out = features.build_records(_flagged(spark, sf), "ndvi_only", R.windows(spark), round4=True)
    rows = out.select(
        *R.SERIES, "start_doy", "end_doy", "num_observations", "feature_set",
        F.inline(F.arrays_zip(F.col("x")[0].alias("v"), F.col("x")[1].alias("f"), F.sequence(F.lit(0), F.lit(72)).alias("bin"))).alias("v", "f", "bin"))
    return rows.select(*R.SERIES, "start_doy", "end_doy", "num_observations", "feature_set", "bin", r6("v").alias("ndvi"), r6("f").alias("valid_fraction"))


@plan("encode_targets", R.sql("labelled", """
SELECT year, tile, crop, round(coalesce(start_doy / 366::DOUBLE, 0)::FLOAT::DOUBLE, 6) AS y0, round(coalesce(end_doy / 366::DOUBLE, 0)::FLOAT::DOUBLE, 6) AS y1 FROM labelled"""))
def encode_targets(spark, sf):
    rows = _flagged(spark, sf).withColumn("doy", F.dayofyear("date"))
    out = features.encode_targets(features.labels_from_rows(rows, R.SERIES))
    return out.select(*R.SERIES, r6(F.col("y")[0]).alias("y0"), r6(F.col("y")[1]).alias("y1"))


# ---------------------------------------------------------------- summaries

@plan("union_summaries", R.sql("timeline predictions", """
SELECT 'crop' AS level, tile, crop AS "Crop", date::VARCHAR AS "Date", CASE WHEN harvest = 'Start' THEN coalesce(div_start, -1) ELSE -1 END::BIGINT AS div_start FROM timeline
UNION ALL SELECT 'tile', tile, crop, '', pred_start_doy FROM predictions"""))
def union_summaries(spark, sf):
    a = _timeline(spark, sf).select(F.lit("crop").alias("level"), "tile", F.col("crop").alias("Crop"), day("date").alias("Date"), F.col("div_start").cast("bigint").alias("div_start"))
    b = R.predictions(spark, sf).select(F.lit("tile").alias("level"), "tile", F.col("crop").alias("Crop"), F.col("pred_start_doy").cast("bigint").alias("div_result_start"))
    out = O.union_summaries(a, b)
    return out.withColumns({"Date": F.coalesce("Date", F.lit("")), "div_start": num("div_start")})


@plan("farm_summary_rows", R.sql("timeline seeding", """
, t AS (SELECT timeline.*, s.offset_days, s.window_start, s.window_end FROM timeline LEFT JOIN seeding s USING (crop))
SELECT year, crop AS "Crop", tile AS "FarmID", coalesce(max(date) FILTER (WHERE harvest = 'Start')::VARCHAR, '') AS "HarvestStart",
  coalesce(max(date) FILTER (WHERE harvest = 'End')::VARCHAR, '') AS "HarvestEnd",
  coalesce(max(date) FILTER (WHERE contains(seeding_event, 'GreenupStart'))::VARCHAR, '') AS "GreenupStart",
  coalesce(max(date) FILTER (WHERE contains(seeding_event, 'EstimatedSeedingDate'))::VARCHAR, '') AS "EstimatedSeedingDate",
  coalesce(max(nullif(greenup_source, '')) FILTER (WHERE seeding_event <> ''), '') AS "SeedingSource",
  coalesce(max(nullif(greenup_rule, '')) FILTER (WHERE seeding_event <> ''), '') AS "SeedingRule",
  coalesce((max(offset_days) FILTER (WHERE seeding_event <> ''))::VARCHAR, '') AS "SeedingOffsetDays",
  coalesce(max(window_start) FILTER (WHERE seeding_event <> ''), '') AS "SeedingWindowStart",
  coalesce(max(window_end) FILTER (WHERE seeding_event <> ''), '') AS "SeedingWindowEnd", '' AS "SourceCSV"
FROM t GROUP BY year, tile, crop"""))
def farm_summary_rows(spark, sf):
    from fieldtide.sources.sinks import farm_summary_rows as layout

    key = ("year", "crop", "farm_id")
    rows = O.row_numbers(_timeline(spark, sf).withColumn("farm_id", F.col("tile")), key)
    return layout(O.farm_season_summary(rows, key))


@plan("season_summary_round_trip", R.sql("timeline", """
SELECT year, tile, crop AS "Crop", date::VARCHAR AS "Date", round(coalesce(ndvi, -9), 4) AS "NDVI", harvest AS "Harvest" FROM timeline"""))
def season_summary_round_trip(spark, sf):
    from fieldtide.plans.operation_plans import _folder
    from fieldtide.sources.sinks import write_season_summary
    from fieldtide.sources.tables import read_season_summary

    path = _folder(spark) + "/summary"
    write_season_summary(_timeline(spark, sf), path)
    out = read_season_summary(spark, path)
    return out.select("year", "tile", "Crop", day("Date").alias("Date"), F.coalesce("NDVI", F.lit(-9.0)).alias("NDVI"),
                      F.coalesce("Harvest", F.lit("")).alias("Harvest"))


@plan("with_seeding", R.sql("predictions seeding", """
SELECT year, tile, crop, coalesce(year || '-' || window_start, '') AS sow_from, coalesce(year || '-' || window_end, '') AS sow_to, coalesce(offset_days, -1)::BIGINT AS offset_days
FROM predictions LEFT JOIN seeding USING (crop)"""))
def with_seeding(spark, sf):
    from fieldtide.sources.dimensions import with_seeding as attach

    out = attach(R.predictions(spark, sf), R.seeding(spark))
    return out.select(*R.SERIES, day("sow_from").alias("sow_from"), day("sow_to").alias("sow_to"), num("offset_days").alias("offset_days"))
