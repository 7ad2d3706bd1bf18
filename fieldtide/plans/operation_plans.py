"""Planning, audit, document and streaming plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from fieldtide.functions import dates as D, geometry as G, indices as X, text as T
from fieldtide.operators import audit, planning as P, spatial
from fieldtide.plans import relations as R
from fieldtide.plans.registry import bit, day, num, plan, r6


def _wanted(spark, sf):
    return R.requested_tiles(spark, sf)


# ---------------------------------------------------------------- planning

@plan("date_coverage", R.sql("coverage", "SELECT month, date::VARCHAR AS date, tiles FROM coverage"))
def date_coverage(spark, sf):
    out = P.date_coverage(P.valid_dates(R.acquisitions(spark, sf)))
    return out.withColumn("date", day("date"))


@plan("top_dates", R.sql("coverage", """
SELECT month, date::VARCHAR AS date, tiles, row_number() OVER (PARTITION BY month ORDER BY tiles DESC, coverage.date DESC)::INT AS rank FROM coverage QUALIFY rank <= 10"""))
def top_dates(spark, sf):
    return P.top_dates(P.date_coverage(P.valid_dates(R.acquisitions(spark, sf)))).withColumn("date", day("date"))


def _planned(spark, sf):
    return P.anchor_plan(_wanted(spark, sf), R.acquisitions(spark, sf))


@plan("anchor_plan", R.sql("planned", """
SELECT month, tile, status, coalesce(date::VARCHAR, '') AS date, coalesce(gap_days, -1)::BIGINT AS gap_days, coalesce(anchor_date::VARCHAR, '') AS anchor_date FROM planned"""))
def anchor_plan(spark, sf):
    return _planned(spark, sf).select("month", "tile", "status", day("date").alias("date"), num("gap_days").alias("gap_days"), day("anchor_date").alias("anchor_date"))


@plan("plan_summary", R.sql("planned plancov", """
, g AS (SELECT month, gap_days, count(*) AS n FROM planned WHERE date IS NOT NULL GROUP BY ALL),
h AS (SELECT month, string_agg(gap_days || ':' || n, ',' ORDER BY gap_days::VARCHAR) AS hist FROM g GROUP BY month),
t AS (SELECT month, date, tiles FROM plancov QUALIFY row_number() OVER (PARTITION BY month ORDER BY tiles DESC, date DESC) <= 10),
tt AS (SELECT month, string_agg(date || ':' || tiles, ',' ORDER BY tiles DESC, date DESC) AS top, max(tiles) AS cov FROM t GROUP BY month)
SELECT p.month, coalesce(max(anchor_date)::VARCHAR, '') AS anchor_date, coalesce(any_value(cov), 0) AS anchor_coverage_tiles, count(p.date) AS planned_tiles, count(*) FILTER (WHERE gap_days = 0) AS anchor_assigned_tiles,
  count(*) FILTER (WHERE gap_days > 0) AS fallback_assigned_tiles, count(*) FILTER (WHERE status = 'meta_patch_missing') AS meta_patch_missing,
  count(*) FILTER (WHERE status = 'no_dates_in_month') AS no_dates_in_month, count(*) FILTER (WHERE status = 'no_valid_observation') AS no_valid_observation,
  count(*) FILTER (WHERE status = 'valid_tiles') AS valid_tiles, coalesce(any_value(hist), '') AS hist, coalesce(any_value(top), '') AS top
FROM planned p LEFT JOIN h USING (month) LEFT JOIN tt USING (month) GROUP BY p.month"""))
def plan_summary(spark, sf):
    coverage = P.date_coverage(P.valid_dates(P.planned_quality(_wanted(spark, sf), R.acquisitions(spark, sf))))
    out = P.plan_summary(_planned(spark, sf), coverage)
    hist = F.array_join(F.transform(F.map_entries("gap_days_hist"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    top = F.array_join(F.transform("top_dates", lambda e: F.concat_ws(":", e["date"].cast("string"), e["tiles"].cast("string"))), ",")
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.withColumns({"hist": text(hist), "top": text(top), "anchor_date": day("anchor_date")}).drop("gap_days_hist", "top_dates")


@plan("nearest_date", R.sql("acq", """
, goal AS (SELECT tile, DATE '2024-01-01' + ((split_part(tile, '_', 1)::INT * 7 + split_part(tile, '_', 2)::INT) % 30)::INT AS goal FROM (SELECT DISTINCT tile FROM acq))
SELECT g.tile, g.goal::VARCHAR AS goal, coalesce((list(a.date ORDER BY abs(date_diff('day', g.goal, a.date)), a.date DESC) FILTER (WHERE a.date IS NOT NULL))[1]::VARCHAR, '') AS date
FROM goal g LEFT JOIN (SELECT * FROM acq WHERE valid) a ON a.tile = g.tile GROUP BY g.tile, g.goal"""))
def nearest_date(spark, sf):
    a = R.acquisitions(spark, sf)
    k = (T.tile_i(F.col("tile")) * 7 + T.tile_j(F.col("tile"))) % 30
    goals = a.select("tile").distinct().withColumn("goal", F.date_add(F.lit("2024-01-01").cast("date"), k))
    out = P.nearest_date(goals, a.filter("valid"), ["tile"])
    return out.select("tile", day("goal").alias("goal"), day("date").alias("date"))


R.cte("shipped", "", """
SELECT DISTINCT (l_suppkey % 20)::VARCHAR || '_' || (l_suppkey // 20)::VARCHAR AS tile, year(l_shipdate)::INT AS year, l_shipdate::DATE AS date FROM lineitem""")


def _shipped(spark, sf):
    return R.lines(spark, sf).select("tile", "year", "date").distinct()


@plan("sample_dates", R.sql("shipped", """
SELECT DISTINCT tile, year, unnest(CASE WHEN month(min(date)) BETWEEN 4 AND 9 THEN [min(date), max(date)]
  ELSE [(list(date ORDER BY abs(day(date) - 15), date))[1]] END)::VARCHAR AS date FROM shipped GROUP BY tile, year, month(date)"""))
def sample_dates(spark, sf):
    return P.sample_dates(_shipped(spark, sf), ("tile", "year")).withColumn("date", day("date"))


@plan("pick_dates", R.sql("acq", """
SELECT 'latest' AS policy, tile, max(date)::VARCHAR AS date FROM acq WHERE valid GROUP BY tile UNION ALL SELECT 'earliest', tile, min(date)::VARCHAR FROM acq WHERE valid GROUP BY tile
UNION ALL SELECT 'all', tile, date::VARCHAR FROM acq WHERE valid"""))
def pick_dates(spark, sf):
    valid = P.valid_dates(R.acquisitions(spark, sf))
    parts = [P.pick_dates(valid, p).withColumn("policy", F.lit(p)) for p in ("latest", "earliest", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("date", day("date"))


@plan("cut_by_max_doy", R.sql("shipped", """
SELECT tile, year, count(*) AS dates FROM shipped WHERE dayofyear(date) <= dayofyear(last_day(make_date(year, greatest(least(split_part(tile, '_', 1)::INT, 11), 6), 1))) GROUP BY ALL"""))
def cut_by_max_doy(spark, sf):
    from fieldtide.operators.quality import cut_by_max_doy as cut

    limit = D.max_doy_for_month(F.col("year"), D.clamp_model_month(T.tile_i(F.col("tile"))))
    return cut(_shipped(spark, sf), limit).groupBy("tile", "year").agg(F.count(F.lit(1)).alias("dates"))


@plan("latest_per_key", """
SELECT user_id, (list({'t': ts, 'i': event_id, 'e': event_type} ORDER BY ts DESC, event_id DESC))[1].i AS event_id,
  (list({'t': ts, 'i': event_id, 'e': event_type} ORDER BY ts DESC, event_id DESC))[1].e AS event_type FROM events GROUP BY user_id""")
def latest_per_key(spark, sf):
    ev = R.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("created_at"),
                                            F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("updated_at"))
    return P.latest_per_key(ev, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


R.cte("late", "acq", "SELECT *, valid AND day(date) % 3 <> 1 AS still FROM acq")


@plan("status_report", R.sql("planned late", """
, b AS (SELECT p.tile, p.status, p.date AS planned, (list(l.date ORDER BY abs(date_diff('day', p.date, l.date)), l.date DESC) FILTER (WHERE l.still AND p.date IS NOT NULL))[1] AS best
  FROM planned p LEFT JOIN late l USING (tile) GROUP BY ALL)
SELECT tile, CASE WHEN status <> 'valid_tiles' THEN status WHEN best IS NULL THEN 'planned_date_not_valid' ELSE '' END AS reason,
  CASE WHEN status = 'valid_tiles' THEN coalesce(best::VARCHAR, '') ELSE '' END AS date, coalesce(best <> planned, FALSE)::INT AS fell_back FROM b"""))
def status_report(spark, sf):
    planned = _planned(spark, sf)
    a = R.acquisitions(spark, sf)
    images = a.select("tile", "date", (F.col("valid") & (F.dayofmonth("date") % 3 != 1)).alias("valid"))
    out = P.status_report(_wanted(spark, sf).select("tile"), planned, images)
    return out.select("tile", F.coalesce("reason", F.lit("")).alias("reason"), day("date").alias("date"), bit("fell_back").alias("fell_back"))


@plan("exact_date_override", R.sql("planned acq", """
, o AS (SELECT tile, DATE '2024-01-01' + (split_part(tile, '_', 1)::INT) AS exact FROM planned WHERE split_part(tile, '_', 2)::INT % 2 = 0)
SELECT p.tile, CASE WHEN o.exact IS NOT NULL THEN CASE WHEN a.tile IS NOT NULL THEN o.exact::VARCHAR ELSE '' END ELSE coalesce(p.date::VARCHAR, '') END AS date,
  CASE WHEN o.exact IS NOT NULL THEN CASE WHEN a.tile IS NULL THEN 'exact_date_missing_or_invalid' ELSE '' END WHEN p.date IS NULL THEN p.status ELSE '' END AS reason,
  (o.exact IS NOT NULL AND a.tile IS NOT NULL)::INT AS overridden
FROM planned p LEFT JOIN o USING (tile) LEFT JOIN (SELECT DISTINCT tile, date FROM acq) a ON a.tile = p.tile AND a.date = o.exact"""))
def exact_date_override(spark, sf):
    planned = _planned(spark, sf)
    over = _wanted(spark, sf).filter(T.tile_j(F.col("tile")) % 2 == 0).select(
        "tile", F.date_add(F.lit("2024-01-01").cast("date"), T.tile_i(F.col("tile"))).alias("date"))
    out = P.exact_date_override(planned, over, R.acquisitions(spark, sf).select("tile", "date"))
    return out.select("tile", day("date").alias("date"), F.coalesce("reason", F.lit("")).alias("reason"), bit("overridden").alias("overridden"))


# ---------------------------------------------------------------- audits

R.cte("ledger", "", """
SELECT (o_custkey % 20)::VARCHAR || '_' || (o_custkey // 20)::VARCHAR AS tile, ['global', 'farm', 'summary', 'cleanup_npy'][(o_orderkey % 4 + 1)::INT] AS stage,
  bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY ALL""")
R.cte("custtiles", "", """
SELECT (c_custkey % 20)::VARCHAR || '_' || (c_custkey // 20)::VARCHAR AS tile, c_custkey % 7 <> 0 AS has_mask FROM customer""")


def _ledger(spark, sf):
    o = R.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    stage = F.element_at(F.array(*[F.lit(s) for s in audit.STAGES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    g = o.groupBy(R._tile_of(F.col("o_custkey")).alias("tile"), stage.alias("stage")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    return g.select("tile", "stage", F.when(F.col("done"), "completed").otherwise("odd").alias("status"))


def _cust_tiles(spark, sf):
    c = R.table(spark, sf, "customer").select("c_custkey")
    return c.select(R._tile_of(F.col("c_custkey")).alias("tile"), (F.col("c_custkey") % 7 != 0).alias("has_mask"))


@plan("pending_work", R.sql("ledger custtiles", """
SELECT tile, s.stage FROM custtiles c, (VALUES ('global'), ('farm'), ('summary'), ('cleanup_npy')) s(stage) WHERE has_mask
  AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.tile = c.tile AND l.stage = s.stage AND l.done)"""))
def pending_work(spark, sf):
    return audit.pending_work(_cust_tiles(spark, sf), _ledger(spark, sf))


@plan("tile_completion", R.sql("ledger custtiles", """
SELECT c.tile, count(*) FILTER (WHERE l.done)::INT AS done, (count(*) FILTER (WHERE l.done) = 4)::INT AS complete FROM custtiles c LEFT JOIN ledger l USING (tile) GROUP BY c.tile"""))
def tile_completion(spark, sf):
    return audit.tile_completion(_cust_tiles(spark, sf), _ledger(spark, sf)).withColumn("complete", bit("complete"))


R.cte("bandfiles", "", """
SELECT tile, date, band, max(len) AS length FROM (SELECT (l_suppkey % 20)::VARCHAR || '_' || (l_suppkey // 20)::VARCHAR AS tile, l_shipdate::DATE AS date,
  ['B2', 'B3', 'B4', 'SCL'][l_linenumber % 4 + 1] AS band, CASE WHEN l_quantity < 10 THEN 0 ELSE l_quantity::BIGINT * 4000000 END AS len FROM lineitem) GROUP BY ALL""")


def _band_files(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_quantity")
    band = F.element_at(F.array(*[F.lit(b) for b in ("B2", "B3", "B4", "SCL")]), F.col("l_linenumber") % 4 + 1)
    size = F.when(F.col("l_quantity") < 10, 0).otherwise(F.col("l_quantity").cast("bigint") * 4000000)
    return li.groupBy(R._tile_of(F.col("l_suppkey")).alias("tile"), F.to_date("l_shipdate").alias("date"), band.alias("band")).agg(F.max(size).alias("length"))


@plan("missing_files", R.sql("bandfiles shipped", """
SELECT s.tile, s.date::VARCHAR AS date, b.band FROM (SELECT DISTINCT tile, date FROM shipped) s, (VALUES ('B2'), ('B3'), ('B4'), ('SCL')) b(band)
WHERE NOT EXISTS (SELECT 1 FROM bandfiles f WHERE f.tile = s.tile AND f.date = s.date AND f.band = b.band AND f.length > 0)"""))
def missing_files(spark, sf):
    dates = _shipped(spark, sf).select("tile", "date").distinct()
    return audit.missing_files(dates, _band_files(spark, sf), ("B2", "B3", "B4", "SCL")).withColumn("date", day("date"))


@plan("needs_download", R.sql("bandfiles tiles", """
, w AS (SELECT tile, split_part(tile, '_', 1)::INT AS i, split_part(tile, '_', 2)::INT AS j FROM tiles),
st AS (SELECT w.*, (i + j) % 4 <> 0 AS complete, CASE WHEN i % 3 = 0 THEN NULL ELSE 20 END AS ct,
    (SELECT list(date ORDER BY date)[1:2] FROM (SELECT DISTINCT date FROM bandfiles f WHERE f.tile = w.tile AND length > 0)) AS dates FROM w WHERE j % 7 <> 6),
x AS (SELECT w.tile, w.i, coalesce(st.complete, FALSE) AND coalesce(len(st.dates), 0) > 0 AND st.ct IS NOT DISTINCT FROM (CASE WHEN w.i % 2 = 0 THEN 20 END) AS same, st.dates FROM w LEFT JOIN st USING (tile)),
m AS (SELECT x.tile, count(*) AS missing FROM (SELECT tile, unnest(dates) AS date FROM x WHERE same) x, (VALUES ('B2'), ('SCL')) b(band)
  WHERE NOT EXISTS (SELECT 1 FROM bandfiles f WHERE f.tile = x.tile AND f.date = x.date AND f.band = b.band AND f.length > 0) GROUP BY x.tile)
SELECT x.tile, same::INT AS same_run, coalesce(missing, 0)::INT AS missing, (NOT same OR coalesce(missing, 0) > 0)::INT AS run FROM x LEFT JOIN m USING (tile)"""))
def needs_download(spark, sf):
    files = _band_files(spark, sf)
    i, j = T.tile_i(F.col("tile")), T.tile_j(F.col("tile"))
    wanted = R.tiles(spark, sf).select("tile", F.when(i % 2 == 0, 20).alias("cloud"))
    # First two dates per tile, as two nested minima.
    d = files.filter("length > 0").select("tile", "date").distinct()
    one = d.groupBy("tile").agg(F.min("date").alias("d1"))
    two = d.join(one, "tile").groupBy("tile", "d1").agg(F.min(F.when(F.col("date") > F.col("d1"), F.col("date"))).alias("d2"))
    state = R.tiles(spark, sf).filter(j % 7 != 6).join(two, "tile", "left").select(
        "tile", ((i + j) % 4 != 0).alias("complete"), F.when(i % 3 != 0, 20).alias("cloud"),
        F.array_compact(F.array("d1", "d2")).alias("dates"))
    out = audit.needs_download(wanted, state, files, ("B2", "SCL"), ("cloud",))
    return out.select("tile", bit("same_run").alias("same_run"), "missing", bit("run").alias("run"))


@plan("incomplete_outputs", R.sql("bandfiles custtiles", """
SELECT c.tile, m.month::INT AS month, coalesce(f.length, 0)::BIGINT AS bytes, CASE WHEN f.tile IS NULL THEN 'missing' WHEN f.length < 198 * 1048576 THEN 'small' ELSE 'kept' END AS kind,
  (f.tile IS NULL OR f.length < 198 * 1048576)::INT AS rerun FROM custtiles c JOIN range(1, 13) m(month) ON true
  LEFT JOIN (SELECT tile, month(date) AS month, max(length) AS length FROM bandfiles GROUP BY ALL) f ON f.tile = c.tile AND f.month = m.month"""))
def incomplete_outputs(spark, sf):
    """Every tile in every month of the year."""
    files = _band_files(spark, sf).withColumn("month", F.month("date"))
    wanted = _cust_tiles(spark, sf).select("tile", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return audit.incomplete_outputs(wanted, files, 198.0, key=("tile", "month")).withColumn("rerun", bit("rerun"))


@plan("run_progress", """
SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS done, count(*) FILTER (WHERE event_type = 'purchase') AS written,
  count(*) FILTER (WHERE event_type IN ('click', 'signup')) AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id""")
def run_progress(spark, sf):
    e = F.col("event_type")
    status = F.when(e == "purchase", "written").when(e == "click", "skipped").when(e == "signup", "skipped_existing").when(e == "error", "failed").otherwise("pending")
    return audit.run_progress(R.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), status.alias("status")))


@plan("interrupted_jobs", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' ELSE 'completed' END AS state,
  CASE WHEN event_type IN ('click', 'view') THEN 'later' ELSE '' END AS finished_at, CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE 1 END AS errors FROM events""")
def interrupted_jobs(spark, sf):
    e = F.col("event_type")
    jobs = R.table(spark, sf, "events").select(
        "event_id", F.when(e == "click", "queued").when(e == "view", "running").otherwise("completed").alias("state"),
        F.lit("x").alias("phase"), F.lit("").alias("updated_at"), F.lit("").alias("finished_at"), F.array(F.lit("first")).alias("errors"))
    out = audit.interrupted_jobs(jobs, F.lit("later"))
    return out.select("event_id", "state", "finished_at", F.size("errors").alias("errors"))


@plan("request_plan", R.sql("boxes tiles", """
, outs AS (SELECT * FROM tiles WHERE split_part(tile, '_', 1)::INT % 4 <> 3),
cells AS (SELECT b.request_id, c.i || '_' || c.j AS tile FROM boxes b JOIN (SELECT i, j, """ + R.cell_bounds_sql("i", "j") + """ FROM range(20) a(i), range(20) b(j)) c
  ON c.lon_min <= b.lon_max AND c.lon_max >= b.lon_min AND c.lat_min <= b.lat_max AND c.lat_max >= b.lat_min),
n AS (SELECT request_id, count(*) AS cells, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.tile = cells.tile)) AS lacking FROM cells GROUP BY ALL),
m AS (SELECT DISTINCT b.request_id FROM boxes b JOIN (SELECT min(lon_min) AS lon_min, min(lat_min) AS lat_min, max(lon_max) AS lon_max, max(lat_max) AS lat_max
  FROM tiles WHERE split_part(tile, '_', 1)::INT % 4 = 3 AND split_part(tile, '_', 2)::INT < 3 GROUP BY split_part(tile, '_', 1)) o
  ON o.lon_min <= b.lon_max AND o.lon_max >= b.lon_min AND o.lat_min <= b.lat_max AND o.lat_max >= b.lat_min),
h AS (SELECT b.request_id, count(DISTINCT o.tile) AS hits FROM boxes b JOIN outs o ON o.lon_min <= b.lon_max AND o.lon_max >= b.lon_min AND o.lat_min <= b.lat_max AND o.lat_max >= b.lat_min GROUP BY ALL)
SELECT b.request_id, coalesce(n.cells, 0)::INT AS cells, coalesce(hits, 0)::INT AS outputs, coalesce(lacking, 0)::INT AS missing_cells,
  CASE WHEN m.request_id IS NOT NULL OR (coalesce(hits, 0) > 0 AND hits >= coalesce(n.cells, 0)) OR coalesce(lacking, 0) = 0 THEN 'ready'
    WHEN b.request_id % 4 = 0 THEN 'attach' WHEN b.request_id % 4 = 1 THEN 'not_available' ELSE 'new' END AS decision
FROM boxes b LEFT JOIN n USING (request_id) LEFT JOIN h USING (request_id) LEFT JOIN m USING (request_id)"""))
def request_plan(spark, sf):
    """Mosaics cover strips of the columns without outputs, near the lower edge."""
    boxes = R.boxes(spark, sf)
    outs = R.tiles(spark, sf).filter(T.tile_i(F.col("tile")) % 4 != 3)
    k = F.col("request_id")
    keyed = boxes.withColumn("job_key", F.concat(F.lit("k"), k.cast("string")))
    jobs = keyed.select("job_key", F.when(k % 4 == 0, "running").when(k % 4 == 1, "completed").when(k % 4 == 2, "failed").alias("state")).filter("state is not null")
    i, j = T.tile_i(F.col("tile")), T.tile_j(F.col("tile"))
    strips = R.tiles(spark, sf).filter((i % 4 == 3) & (j < 3)).groupBy(i.cast("string").alias("tile")).agg(
        *[F.min(c).alias(c) for c in ("lon_min", "lat_min")], *[F.max(c).alias(c) for c in ("lon_max", "lat_max")])
    return audit.request_plan(keyed, outs, jobs, strips)


@plan("split_audit", R.sql("predictions", """
, r AS (SELECT year, tile, crop, CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' WHEN year = 2000 THEN 'test' END AS split FROM predictions
  UNION ALL SELECT year, tile, crop, 'val' FROM predictions WHERE year = 1998 AND crop = 'Rye' UNION ALL SELECT year, tile, crop, 'test' FROM predictions WHERE year = 1999 AND crop = 'Corn'),
d AS (SELECT DISTINCT * FROM r WHERE split IS NOT NULL)
SELECT 'split' AS kind, split AS item, count(*) AS records FROM r WHERE split IS NOT NULL GROUP BY split UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM r GROUP BY year
UNION ALL SELECT 'overlap', a.split || '&' || b.split, count(*) FROM d a JOIN d b USING (year, tile, crop) WHERE a.split < b.split GROUP BY a.split, b.split
UNION ALL SELECT 'unassigned', 'unassigned', count(*) FROM r WHERE split IS NULL"""))
def split_audit(spark, sf):
    p = R.predictions(spark, sf).select(*R.SERIES)
    y = F.col("year")
    r = p.withColumn("split", F.when(y <= 1998, "train").when(y == 1999, "val").when(y == 2000, "test"))
    r = r.unionByName(p.filter("year = 1998 and crop = 'Rye'").withColumn("split", F.lit("val")))
    r = r.unionByName(p.filter("year = 1999 and crop = 'Corn'").withColumn("split", F.lit("test")))
    return audit.split_audit(r)


@plan("shared_records", R.sql("predictions", """
SELECT year, tile, crop, pred_start_doy FROM predictions INTERSECT SELECT year - 1, tile, crop, pred_start_doy FROM predictions"""))
def shared_records(spark, sf):
    """Records of every year that come back in the next one."""
    p = R.predictions(spark, sf)
    return audit.shared_records(p, p.withColumn("year", F.col("year") - 1), ("year", "tile", "crop", "pred_start_doy"))


@plan("dedupe_keep_first", "SELECT l_suppkey AS tile, (list(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey))[1] AS l_partkey FROM lineitem GROUP BY l_suppkey")
def dedupe_keep_first(spark, sf):
    li = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), F.struct("l_orderkey", "l_linenumber").alias("position"), "l_partkey")
    return audit.dedupe_keep_first(li).select("tile", "l_partkey")


_PATHS = """SELECT *, '/data/output/' || tile || CASE o_orderkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '_' || strftime(d, '%Y%m%d') || '.tif' ELSE '_preview.png' END AS path FROM (
  SELECT o_orderkey, (o_custkey % 20)::VARCHAR || '_' || (o_custkey // 20)::VARCHAR AS tile, o_orderdate::DATE AS d FROM orders)"""
R.cte("outpaths", "", _PATHS)


def _out_paths(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 3
    tail = F.when(k == 0, ".tif").when(k == 1, F.concat(F.lit("_"), F.date_format("d", "yyyyMMdd"), F.lit(".tif"))).otherwise("_preview.png")
    tile = R._tile_of(F.col("o_custkey"))
    return o.select("o_orderkey", tile.alias("tile"), "d", F.concat(F.lit("/data/output/"), tile, tail).alias("path"))


@plan("existing_outputs", R.sql("outpaths custtiles", """
SELECT 'all' AS policy, c.tile, coalesce(p.path, '') AS path, coalesce(p.d::VARCHAR, '') AS date FROM custtiles c LEFT JOIN (SELECT * FROM outpaths WHERE o_orderkey % 3 = 1) p USING (tile)
UNION ALL
SELECT 'latest', c.tile, coalesce(p.path, ''), CASE WHEN p.path IS NULL OR split_part(c.tile, '_', 1)::INT % 4 = 3 THEN '' ELSE (DATE '2024-01-01' + (length(c.tile) * 40 + split_part(c.tile, '_', 1)::INT)::INT)::VARCHAR END
FROM custtiles c LEFT JOIN (SELECT * FROM outpaths WHERE o_orderkey % 3 = 0) p USING (tile)"""))
def existing_outputs(spark, sf):
    """Dated names under one policy; under the other, dates from sidecar documents, of which every fourth is damaged."""
    from fieldtide.sources.tables import read_sidecars

    tiles, paths = _cust_tiles(spark, sf).select("tile"), _out_paths(spark, sf).select("path")
    i = T.tile_i(F.col("tile"))
    used = F.date_add(F.lit("2024-01-01").cast("date"), F.length("tile") * 40 + i)
    # A folder a column of tiles, one array of documents in each; folders of dated outputs lie beside them.
    doc = F.struct(F.col("tile").alias("meta_patch"), F.date_format(used, "yyyy-MM-dd").alias("date"))
    held = tiles.groupBy(i.alias("i")).agg(F.to_json(F.collect_list(doc)).alias("value"))
    held = held.withColumn("value", F.when(F.col("i") % 4 == 3, F.substring("value", 1, 20)).otherwise(F.col("value")))
    root = _folder(spark) + "/sidecars"
    for kind, text in (("plain", F.col("value")), ("dated", F.regexp_replace("value", "2024-", "1999-"))):
        held.select(F.concat(F.lit(kind + "_"), F.col("i").cast("string")).alias("name"), text.alias("value")).write.mode("append").partitionBy("name").text(root)
    notes = read_sidecars(spark, root, "*.txt", dateless=r"/name=plain_\d+()/")
    parts = [("all", None), ("latest", notes)]
    out = [audit.existing_outputs(tiles, paths, policy, side).withColumn("policy", F.lit(policy)) for policy, side in parts]
    out = out[0].unionByName(out[1])
    return out.select("policy", "tile", F.coalesce("path", F.lit("")).alias("path"), day("date").alias("date"))


@plan("date_from_output_name", R.sql("outpaths", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN d::VARCHAR ELSE '' END AS date FROM outpaths"))
def date_from_output_name(spark, sf):
    return _out_paths(spark, sf).select("o_orderkey", day(D.date_from_output_name(F.col("path"))).alias("date"))


# ---------------------------------------------------------------- listings and documents

R.cte("listing", "", """
SELECT l_orderkey, '/archive/' || year(l_shipdate) || '_AR/' || (l_suppkey % 20) || '_' || (l_suppkey // 20) || '/' || CASE WHEN l_linenumber = 7 THEN '2024-13-45' ELSE l_shipdate::DATE::VARCHAR END
  || '/' || ['B2', 'B8A', 'SCL', 'B4'][l_linenumber % 4 + 1] || '_' || l_shipdate::DATE || '.tif' AS path, l_quantity::BIGINT AS length, l_linenumber, l_shipdate::DATE AS d, l_suppkey FROM lineitem""")


def _listing(spark, sf):
    li = R.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_quantity")
    d = F.to_date("l_shipdate").cast("string")
    band = F.element_at(F.array(*[F.lit(b) for b in ("B2", "B8A", "SCL", "B4")]), F.col("l_linenumber") % 4 + 1)
    folder = F.when(F.col("l_linenumber") == 7, "2024-13-45").otherwise(d)
    path = F.concat(F.lit("/archive/"), F.year("l_shipdate").cast("string"), F.lit("_AR/"), R._tile_of(F.col("l_suppkey")),
                    F.lit("/"), folder, F.lit("/"), band, F.lit("_"), d, F.lit(".tif"))
    return li.select("l_orderkey", path.alias("path"), F.col("l_quantity").cast("bigint").alias("length"))


@plan("inventory", R.sql("listing", """
SELECT path, length, year(d)::INT AS year, (l_suppkey % 20) || '_' || (l_suppkey // 20) AS tile, d::VARCHAR AS date, ['B2', 'B8A', 'SCL', 'B4'][l_linenumber % 4 + 1] AS band
FROM listing WHERE l_linenumber <> 7 AND d BETWEEN DATE '1996-03-01' AND DATE '1999-12-31'"""))
def inventory(spark, sf):
    from fieldtide.sources.files import inventory as keys

    return keys(_listing(spark, sf).select("path", "length"), "1996-03-01", "1999-12-31").withColumn("date", day("date"))


@plan("tile_footprint", R.sql("listing", """
, f AS (SELECT path, (l_suppkey % 20) || '_' || (l_suppkey // 20) AS tile, FALSE AS cdl FROM listing WHERE l_linenumber % 4 = 3
  UNION ALL SELECT '/archive/masks/' || (s_suppkey % 20) || '_' || (s_suppkey // 20) || '/cdl.tif', (s_suppkey % 20) || '_' || (s_suppkey // 20), TRUE FROM supplier WHERE s_suppkey % 3 = 0)
SELECT tile, (list(path ORDER BY cdl DESC, path))[1] AS path FROM f GROUP BY tile"""))
def tile_footprint(spark, sf):
    from fieldtide.sources.files import tile_footprint as footprint

    s = R.table(spark, sf, "supplier").filter("s_suppkey % 3 = 0")
    masks = s.select(F.concat(F.lit("/archive/masks/"), R._tile_of(F.col("s_suppkey")), F.lit("/cdl.tif")).alias("path"))
    return footprint(_listing(spark, sf).select("path").unionByName(masks)).select("tile", "path")


@plan("available_years", """
SELECT year, (list(path ORDER BY rank, path))[1] AS path FROM (
  SELECT DISTINCT year(l_shipdate)::INT AS year, l_linenumber % 2 AS rank, CASE WHEN l_linenumber % 2 = 0 THEN '/art/output_' || year(l_shipdate) ELSE '/art/' || year(l_shipdate) END || '/1year/all_indices/predictions.csv' AS path
  FROM lineitem WHERE NOT (year(l_shipdate) = 1997 AND l_linenumber % 2 = 0)) GROUP BY year""")
def available_years(spark, sf):
    from fieldtide.sources.files import available_years as years

    li = R.table(spark, sf, "lineitem").filter((F.year("l_shipdate") != 1997) | (F.col("l_linenumber") % 2 != 0))
    y = F.year("l_shipdate").cast("string")
    head = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/art/output_"), y)).otherwise(F.concat(F.lit("/art/"), y))
    return years(li.select(F.concat(head, F.lit("/1year/all_indices/predictions.csv")).alias("path")), "1year", "all_indices", "predictions.csv")


@plan("scene_manifest", R.sql("tiles", """
SELECT CASE WHEN k % 4 = 0 THEN 'scene' || k ELSE 'id' || k END AS id, '2024-08-13' AS acquired_day, round(lon_min, 6) AS lon_min, round(lat_min, 6) AS lat_min, round(lon_max, 6) AS lon_max, round(lat_max, 6) AS lat_max
FROM (SELECT *, split_part(tile, '_', 1)::INT + 20 * split_part(tile, '_', 2)::INT AS k FROM tiles) WHERE k % 5 <> 4"""))
def scene_manifest(spark, sf):
    from fieldtide.sources.tables import scenes_from_documents
    from fieldtide import schemas

    k = T.tile_i(F.col("tile")) + 20 * T.tile_j(F.col("tile"))
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (
        ("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min"))])
    ring = F.when(k % 5 == 4, F.slice(ring, 1, 3)).otherwise(ring)
    doc = F.to_json(F.struct(
        F.when(k % 4 != 0, F.concat(F.lit("id"), k.cast("string"))).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.lit("2024-08-13T17:01:02Z").alias("acquired")).alias("properties")))
    docs = R.tiles(spark, sf).select(
        F.from_json(doc, schemas.SCENE_DOCUMENT).alias("d"), F.concat(F.lit("/scenes/scene"), k.cast("string"), F.lit("_metadata.json")).alias("metadata_path"))
    out = scenes_from_documents(docs.select("d.*", "metadata_path"))
    return out.select("id", day("acquired_day").alias("acquired_day"), *[r6(c).alias(c) for c in spatial.BOUNDS])


@plan("request_fingerprint", R.sql("boxes", """
, cells AS (SELECT b.request_id, b.year, c.i || '_' || c.j AS tile FROM boxes b JOIN (SELECT i, j, """ + R.cell_bounds_sql("i", "j") + """ FROM range(20) a(i), range(20) b(j)) c
  ON c.lon_min <= b.lon_max AND c.lon_max >= b.lon_min AND c.lat_min <= b.lat_max AND c.lat_max >= b.lat_min)
SELECT request_id, sha1('{"tiles":[' || string_agg('"' || tile || '"', ',' ORDER BY tile) || '],"year":' || year || '}') AS job_key FROM cells GROUP BY request_id, year"""))
def request_fingerprint(spark, sf):
    # A request names canonical cells, at most the 400 of the grid.
    cells = spatial.grid_cells_for_bbox(R.boxes(spark, sf), keep=("request_id", "year"))
    g = cells.groupBy("request_id", "year").agg(F.collect_list("tile").alias("tiles"))
    return g.select("request_id", T.request_fingerprint({"year": ("int", F.col("year")), "tiles": ("texts", F.col("tiles"))}).alias("job_key"))


@plan("date_policy", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'statewide_anchor' WHEN 'view' THEN 'latest' WHEN 'error' THEN 'all' WHEN 'purchase' THEN 'statewide_anchor' ELSE '' END AS policy FROM events""")
def date_policy(spark, sf):
    e = F.col("event_type")
    raw = F.when(e == "click", " Anchor_Latest ").when(e == "view", "LATEST").when(e == "error", "all").when(e == "purchase", "similar_date").otherwise("newest")
    return R.table(spark, sf, "events").select("event_id", F.coalesce(T.normalize_date_policy(raw), F.lit("")).alias("policy"))


@plan("to_double_lenient", """
SELECT doc_id, coalesce(CASE WHEN isfinite(v) THEN v END, -1) AS first_number FROM (SELECT doc_id, try_cast(nullif(trim(text), '') AS DOUBLE) AS v
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || n_chars || '.5 ' WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE source END AS text FROM documents))""")
def to_double_lenient(spark, sf):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(".5 "))).when(k == 1, "NaN").when(k == 2, "").otherwise(F.col("source"))
    return R.table(spark, sf, "documents").select("doc_id", F.coalesce(T.to_double_lenient(raw), F.lit(-1.0)).alias("first_number"))


@plan("safe_names", """
SELECT p_partkey, trim(regexp_replace(replace(p_name || '  /  ' || p_type, '/', '-'), '\\s+', ' ', 'g')) AS folder, replace(p_name || '/' || p_type, '/', '_') AS model,
  CASE p_size % 3 WHEN 0 THEN '2024-01-01_2024-01-31_ct' || p_size || '_mw0' ELSE '2024-01-01_2024-01-31_ct' || p_size || 'p5_mw1' END AS run_tag FROM part""")
def safe_names(spark, sf):
    name, kind = F.col("p_name"), F.col("p_type")
    whole = F.col("p_size") % 3 == 0
    tag = T.run_tag(F.lit("2024-01-01"), F.lit("2024-01-31"), F.col("p_size") + F.when(whole, 0.0).otherwise(0.5), ~whole)
    return R.table(spark, sf, "part").select(
        "p_partkey", T.safe_crop_folder(F.concat(name, F.lit("  /  "), kind)).alias("folder"),
        T.safe_model_name(F.concat(name, F.lit("/"), kind)).alias("model"), tag.alias("run_tag"))


@plan("crop_names", R.sql("mask", """
SELECT tile, row, col, CASE label WHEN 0 THEN 'Background' WHEN 1 THEN 'Corn' WHEN 3 THEN 'Rice' WHEN 5 THEN 'Soybeans' WHEN 27 THEN 'Rye' ELSE 'Crop_' || label END AS crop
FROM (SELECT tile, row, col, label + CASE WHEN row > 5 THEN 20 ELSE 0 END AS label FROM mask)"""))
def crop_names(spark, sf):
    from fieldtide.sources.dimensions import with_crop_names

    m = R.mask(spark, sf).withColumn("label", F.col("label") + F.when(F.col("row") > 5, 20).otherwise(0))
    return with_crop_names(m, R.crops(spark)).select("tile", "row", "col", "crop")


@plan("with_windows", R.sql("predictions windows", """
SELECT year, tile, crop, coalesce(year || '-' || start_md, '') AS target_start, coalesce(year || '-' || end_md, '') AS target_end FROM predictions LEFT JOIN windows USING (crop)"""))
def with_windows(spark, sf):
    from fieldtide.sources.dimensions import with_windows as attach

    out = attach(R.predictions(spark, sf), R.windows(spark))
    return out.select(*R.SERIES, day("target_start").alias("target_start"), day("target_end").alias("target_end"))


@plan("filter_crops_years", R.sql("predictions", "SELECT year, tile, crop, pred_end_doy FROM predictions WHERE crop IN ('Corn', 'Rye') AND year IN (1996, 1999)"))
def filter_crops_years(spark, sf):
    from fieldtide.sources.dimensions import filter_crops_years as keep

    return keep(R.predictions(spark, sf), ["Corn", "Rye"], [1996, 1999]).select(*R.SERIES, "pred_end_doy")


@plan("select_tiles", R.sql("predictions wanted", """
SELECT 'found' AS kind, tile, count(*) AS predictions FROM predictions WHERE tile IN (SELECT tile FROM wanted) GROUP BY tile
UNION ALL SELECT 'unknown', tile, 0 FROM (SELECT DISTINCT tile FROM wanted) WHERE tile NOT IN (SELECT tile FROM predictions)"""))
def select_tiles(spark, sf):
    found, unknown = spatial.select_tiles(R.predictions(spark, sf), _wanted(spark, sf))
    a = found.groupBy("tile").agg(F.count(F.lit(1)).alias("predictions")).withColumn("kind", F.lit("found"))
    return a.unionByName(unknown.select("tile", F.lit(0).cast("bigint").alias("predictions"), F.lit("unknown").alias("kind")))


@plan("month_present", """
WITH m AS (SELECT DISTINCT year(o_orderdate)::INT + y.k::INT AS year, x.month::INT AS month FROM orders, range(-1, 2) y(k), range(1, 13) x(month))
SELECT m.year, m.month, EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = m.year AND month(o_orderdate) = m.month)::INT AS present FROM m""")
def month_present(spark, sf):
    """Months of the years that have files and of those around them."""
    files = R.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    year = F.explode(F.sequence(F.year("date") - 1, F.year("date") + 1)).alias("year")
    months = files.select(year).distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return audit.months_present(files, months).withColumn("present", bit("present"))


@plan("bbox_corners", R.sql("tiles", """
SELECT tile, round(lon_min, 6) AS ul_lon, round(lat_max, 6) AS ul_lat, round(lon_max, 6) AS lr_lon, round(lat_min, 6) AS lr_lat, round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max FROM tiles"""))
def bbox_corners(spark, sf):
    t = R.tiles(spark, sf)
    box = G.normalize_bbox(F.col("lon_max"), F.col("lat_min"), F.col("lon_min"), F.col("lat_max"))
    t = t.select("tile", box.alias("n")).withColumn("c", G.bbox_corners(*[F.col(f"n.{b}") for b in spatial.BOUNDS])).withColumn("b", G.corners_bbox(F.col("c")))
    at = lambda i, k: r6(F.col("c")[i][k])
    return t.select("tile", at(0, 0).alias("ul_lon"), at(0, 1).alias("ul_lat"), at(3, 0).alias("lr_lon"), at(3, 1).alias("lr_lat"),
                    r6("b.lon_min").alias("lon_min"), r6("b.lat_max").alias("lat_max"))


@plan("pixel_coordinates", R.sql("chips headers", """
SELECT tile, date::VARCHAR AS date, row, col, round(x0 + (col + 0.5::DOUBLE) * dx, 9) AS x, round(y0 + (row + 0.5::DOUBLE) * dy, 9) AS y, row AS back_row, col AS back_col FROM chips JOIN headers USING (tile)"""))
def pixel_coordinates(spark, sf):
    px = R.scenes_8bit(spark, sf, ("B4",)).join(R.headers(spark, sf), "tile")
    px = px.withColumn("p", G.pixel_to_xy(*[F.col(c) for c in ("row", "col", "x0", "y0", "dx", "dy")]))
    px = px.withColumn("q", G.xy_to_pixel(F.col("p.x"), F.col("p.y"), *[F.col(c) for c in ("x0", "y0", "dx", "dy")]))
    return px.select("tile", day("date").alias("date"), "row", "col", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), F.col("q.row").alias("back_row"), F.col("q.col").alias("back_col"))


@plan("rgb_compose", R.sql("chips", "SELECT tile, date::VARCHAR AS date, row, col, B4 || ',' || B3 || ',' || B2 AS rgb, B2 || ',' || B3 || ',' || B4 AS bgr, least(greatest(B4 * 2 - 100, 0), 255)::INT AS bright FROM chips"))
def rgb_compose(spark, sf):
    px = R.scenes_8bit(spark, sf)
    b = [F.col(c) for c in ("B4", "B3", "B2")]
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return px.select("tile", day("date").alias("date"), "row", "col", text(X.rgb_compose(*b)).alias("rgb"), text(X.rgb_compose(*b, swap=True)).alias("bgr"),
                     X.clamp_unsigned(F.col("B4") * 2 - 100, 8).alias("bright"))


@plan("band_index_rule", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '3,2,1' WHEN 1 THEN '2,3,1' WHEN 2 THEN '6,4,2' ELSE '1,2,3' END AS bands FROM part""")
def band_index_rule(spark, sf):
    k = F.col("p_size") % 4
    names = F.when(k == 0, F.array(F.lit("Blue"), F.lit(" green"), F.lit("RED"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string")))
    colours = F.when(k == 1, F.array(F.lit("blue"), F.lit("red"), F.lit("green"))).otherwise(F.array(F.lit("grey"), F.lit("x"), F.lit("y")))
    out = T.band_index_rule(names, colours, F.when(k == 2, 8).otherwise(4))
    return R.table(spark, sf, "part").select("p_partkey", F.array_join(out.cast("array<string>"), ",").alias("bands"))


# ---------------------------------------------------------------- files round trips and streams

def _folder(spark) -> str:
    """A fresh folder for intermediate files: next to the shared checkpoint folder on a cluster, else a temporary one."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/fieldtide-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="fieldtide-run-")


@plan("predictions_round_trip", R.sql("predictions", """
SELECT year, tile, crop, pred_start_doy, pred_end_doy, coalesce(num_observations, -1)::BIGINT AS num_observations, coalesce(model_test_mae_days, -1)::DOUBLE AS model_test_mae_days FROM predictions"""))
def predictions_round_trip(spark, sf):
    from fieldtide.sources.sinks import write_predictions
    from fieldtide.sources.tables import read_predictions

    path = _folder(spark) + "/predictions"
    write_predictions(R.predictions(spark, sf), path)
    good, _ = read_predictions(spark, path)
    return good.select(*R.SERIES, "pred_start_doy", "pred_end_doy", num("num_observations").alias("num_observations"),
                       F.coalesce("model_test_mae_days", F.lit(-1.0)).alias("model_test_mae_days"))


@plan("ingest_observations", R.sql("obs", """
SELECT year, tile, crop, date::VARCHAR AS date, round(coalesce(ndvi, -9), 6) AS ndvi FROM obs"""))
def ingest_observations(spark, sf):
    from fieldtide.streaming.ingest import ingest_observations as ingest

    base = _folder(spark)
    obs = R.observations(spark, sf)
    obs.write.parquet(base + "/in")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, base + "/in", obs.schema, base + "/out", base + "/ckpt").awaitTermination()
    out = spark.read.parquet(base + "/out")
    return out.select("year", "tile", "crop", day("date").alias("date"), r6(F.coalesce("ndvi", F.lit(-9.0))).alias("ndvi"))


def _event_stream(spark, sf):
    schema = R.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@plan("latest_job_state", """
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, (list(event_id ORDER BY ts DESC, event_id DESC))[1] AS job_id, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS state FROM events GROUP BY user_id""")
def latest_job_state(spark, sf):
    """Events come out of order, a file a micro-batch; the state is read from the stream's sink."""
    from fieldtide.streaming import ingest

    base, events = _folder(spark), R.table(spark, sf, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(base + "/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    jobs = stream.select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    out = ingest.keep_latest(ingest.latest_job_state(jobs, "user_id", "ts", "event_id"), base + "/jobs", base + "/ckpt", "user_id")
    return out.select("user_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "job_id", "state")


@plan("rolling_coverage", """
SELECT ts::DATE::VARCHAR AS date, count(DISTINCT user_id) AS tiles, count(*) AS scenes FROM events
WHERE ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY ts::DATE""")
def rolling_coverage(spark, sf):
    """Four files in the order of time, then the first days again, too late to count. Days that may still change are open."""
    from fieldtide.streaming import ingest

    base = _folder(spark)
    events = R.table(spark, sf, "events").select("ts", "user_id")
    part = F.floor((F.dayofmonth("ts") - 1) / 8)
    parts = [events.filter(part == k) for k in range(4)]
    late = parts[0].withColumn("user_id", F.col("user_id") + 1_000_000)
    for rows in (*parts, late):
        rows.coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    out = ingest.land(ingest.rolling_coverage(stream, tile="user_id", exact=True), base + "/days", base + "/ckpt")
    return out.select(day("date").alias("date"), "tiles", "scenes")


@plan("exact_coverage", "SELECT ts::DATE::VARCHAR AS date, count(DISTINCT user_id) AS tiles FROM events GROUP BY 1")
def exact_coverage(spark, sf):
    from fieldtide.streaming import ingest

    base = _folder(spark)
    seen = ingest.land(ingest.exact_coverage(_event_stream(spark, sf), tile="user_id", late_days=60), base + "/seen", base + "/ckpt")
    return seen.groupBy(day(F.to_date("day")).alias("date")).agg(F.count(F.lit(1)).alias("tiles"))
