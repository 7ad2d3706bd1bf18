import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from fieldtide.operators import audit, planning as P, spatial
from fieldtide.sources import files as L, pixels as X, sinks, tables
from fieldtide.streaming import ingest

D = lambda n, m=6: dt.date(2024, m, n)


def quality(spark, rows):
    return spark.createDataFrame([("2024-06", *r) for r in rows], "month string, tile string, date date, valid boolean")


def test_nearest_prefers_later(spark):
    left = spark.createDataFrame([("t", D(15))], "tile string, goal date")
    cands = spark.createDataFrame([("t", D(13)), ("t", D(17)), ("u", D(15))], "tile string, date date")
    r = P.nearest_date(left, cands, ["tile"]).first()
    assert (r["date"], r["gap_days"]) == (D(17), 2)


def test_anchor_plan(spark):
    q = quality(spark, [
        ("a", D(1), True), ("b", D(1), True), ("a", D(9), True), ("b", D(9), True), ("c", D(7), True), ("c", D(11), True),
        ("d", D(9), False), ("e", D(9), None)])
    tiles = spark.createDataFrame([("2024-06", t, t != "z") for t in "abcdefz"], "month string, tile string, known boolean")
    planned = P.anchor_plan(tiles, q)
    got = {r["tile"]: r for r in planned.collect()}
    assert got["a"]["date"] == D(9) and got["c"]["date"] == D(11) and got["c"]["gap_days"] == 2
    assert [got[t]["status"] for t in "adefz"] == ["valid_tiles", "no_valid_observation", "no_valid_observation", "no_dates_in_month", "meta_patch_missing"]
    s = P.plan_summary(planned, P.date_coverage(P.valid_dates(q))).first()
    assert (s["anchor_date"], s["planned_tiles"], s["anchor_assigned_tiles"], s["fallback_assigned_tiles"]) == (D(9), 3, 2, 1)
    assert s["gap_days_hist"] == {"0": 2, "2": 1} and s["top_dates"][0]["date"] == D(9) and s["anchor_coverage_tiles"] == 2


def test_tiles_outside_the_plan_do_not_move_the_anchor(spark):
    q = quality(spark, [("a", D(1), True), ("b", D(1), True), ("a", D(9), True), *[(t, D(9), True) for t in ("out", "far", "gone")]])
    tiles = spark.createDataFrame([("2024-06", "a", True), ("2024-06", "b", True), ("2024-06", "gone", False)], "month string, tile string, known boolean")
    planned = P.anchor_plan(tiles, q)
    assert {(r["tile"], r["date"], r["anchor_date"]) for r in planned.collect()} == {("a", D(1), D(1)), ("b", D(1), D(1)), ("gone", None, None)}
    s = P.plan_summary(planned, P.date_coverage(P.valid_dates(P.planned_quality(tiles, q)))).first()
    assert s["anchor_coverage_tiles"] == 2


def test_empty_plan(spark):
    q = quality(spark, [("a", D(1), False)])
    tiles = spark.createDataFrame([("2024-06", "a", True)], "month string, tile string, known boolean")
    s = P.plan_summary(P.anchor_plan(tiles, q), P.date_coverage(P.valid_dates(q))).first()
    assert s["anchor_date"] is None and s["planned_tiles"] == 0 and s["anchor_coverage_tiles"] == 0 and s["no_valid_observation"] == 1


def test_status_and_override(spark):
    planned = spark.createDataFrame([("a", "valid_tiles", D(9)), ("b", "valid_tiles", D(9)), ("c", "no_dates_in_month", None)], "tile string, status string, date date")
    images = spark.createDataFrame([("a", D(9), False), ("a", D(7), True), ("a", D(11), True), ("b", D(9), False)], "tile string, date date, valid boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "tile string")
    got = {r["tile"]: r for r in P.status_report(asked, planned, images).collect()}
    assert got["a"]["date"] == D(11) and got["a"]["fell_back"] is True
    assert [got[t]["reason"] for t in "bcx"] == ["planned_date_not_valid", "no_dates_in_month", "meta_patch_missing"]
    over = spark.createDataFrame([("a", D(7)), ("b", D(3))], "tile string, date date")
    got = {r["tile"]: r for r in P.exact_date_override(planned, over, images).collect()}
    assert got["a"]["date"] == D(7) and got["b"]["reason"] == "exact_date_missing_or_invalid" and got["c"]["reason"] == "no_dates_in_month"


def test_sample_and_pick(spark):
    dates = [D(d, 4) for d in (3, 14, 28)] + [D(d, 1) for d in (10, 20)]
    df = spark.createDataFrame([("t", d) for d in dates], "tile string, date date")
    assert sorted(r["date"] for r in P.sample_dates(df).collect()) == [D(10, 1), D(3, 4), D(28, 4)]
    assert P.sample_dates(df, per_month={1: 1}).count() == 1
    assert P.pick_dates(df, "latest").first()["date"] == D(28, 4) and P.pick_dates(df, "all").count() == 5
    with pytest.raises(ValueError):
        P.pick_dates(df, "statewide_anchor")


def test_latest_and_best(spark):
    jobs = spark.createDataFrame([("k", "1", "b", None), ("k", "2", "a", "b"), ("k", "0", "z", "a")], "job_key string, job_id string, created_at string, updated_at string")
    assert P.latest_per_key(jobs, ["job_key"], "job_id").first()["job_id"] == "2"
    scenes = spark.createDataFrame([(D(1), 5.0, "b"), (D(1), 5.0, "a"), (D(1), 9.0, "c")], "date date, cloud double, id string")
    assert P.best_scene_per_day(scenes).first()["id"] == "a"


def test_ledger(spark):
    tiles = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "tile string, has_mask boolean")
    ledger = spark.createDataFrame([("a", "global", "completed"), ("a", "farm", "odd"), ("c", "global", "completed"), ("c", "farm", "completed")], "tile string, stage string, status string")
    work = audit.pending_work(tiles, ledger, ("global", "farm"))
    assert [tuple(r) for r in work.collect()] == [("a", "farm")]
    done = {r["tile"]: r["complete"] for r in audit.tile_completion(tiles, ledger, ("global", "farm")).collect()}
    assert done == {"a": False, "b": False, "c": True}


def test_needs_download(spark):
    wanted = spark.createDataFrame([("a", 20, None), ("b", 20, None), ("c", 20, 1), ("d", 20, None)], "tile string, cloud int, black int")
    state = spark.createDataFrame([("a", True, [D(1)], 20, None), ("b", True, [D(1)], 20, None), ("c", True, [D(1)], 20, None)], "tile string, complete boolean, dates array<date>, cloud int, black int")
    files = spark.createDataFrame([("a", D(1), "B2", 10), ("a", D(1), "B3", 10), ("b", D(1), "B2", 10), ("b", D(1), "B3", 0)], "tile string, date date, band string, length int")
    got = {r["tile"]: (r["run"], r["missing"]) for r in audit.needs_download(wanted, state, files, ("B2", "B3"), ("cloud", "black")).collect()}
    assert got == {"a": (False, 0), "b": (True, 1), "c": (True, 0), "d": (True, 0)}


def test_incomplete(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "tile string")
    files = spark.createDataFrame([("a", 5), ("b", 1024 * 1024 * 2)], "tile string, length bigint")
    got = {r["tile"]: (r["kind"], r["rerun"]) for r in audit.incomplete_outputs(tiles, files, 1.0, include_missing=False).collect()}
    assert got == {"a": ("small", True), "b": ("kept", False), "c": ("missing", False)}


def test_jobs(spark, tmp_path):
    doc = {"job_id": "1", "job_key": "k", "state": "running", "phase": "x", "errors": ["e"], "updated_at": "u", "finished_at": None}
    (tmp_path / "1.json").write_text(json.dumps(doc))
    (tmp_path / "2.json").write_text("{not json")
    jobs = tables.read_jobs(spark, str(tmp_path / "*.json"))
    r = audit.interrupted_jobs(jobs, F.lit("now")).first()
    assert jobs.count() == 1 and r["state"] == "interrupted" and r["finished_at"] == "now" and len(r["errors"]) == 2
    outs = spark.createDataFrame([("1", s) for s in ("written", "failed", "pending", "skipped_existing")], "job_id string, status string")
    p = audit.run_progress(outs).first()
    assert (p["total"], p["done"], p["written"], p["skipped"], p["failed"]) == (4, 3, 1, 1, 1)


def test_request_plan(spark):
    cols = "lon_min double, lat_min double, lon_max double, lat_max double"
    boxes = spark.createDataFrame([(k, f"k{k}", -92.27, 33.05, -92.23, 33.10) for k in range(4)], "request_id int, job_key string, " + cols)
    far = spark.createDataFrame([("0_0", -94.7, 36.0, -94.6, 36.1)], "tile string, " + cols)
    near = spark.createDataFrame([("whatever", -92.3, 33.0, -92.2, 33.1)], "tile string, " + cols)
    jobs = spark.createDataFrame([("k0", "running"), ("k1", "completed"), ("k2", "failed")], "job_key string, state string")
    got = {r["request_id"]: r["decision"] for r in audit.request_plan(boxes, far, jobs).collect()}
    assert got == {0: "attach", 1: "not_available", 2: "new", 3: "new"}
    assert {r["decision"] for r in audit.request_plan(boxes, near, jobs).collect()} == {"ready"}
    assert {r["decision"] for r in audit.request_plan(boxes, far, jobs, mosaics=near.select(F.lit("m").alias("tile"), *spatial.BOUNDS)).collect()} == {"ready"}


def test_split_audit(spark):
    rows = [(2020, "a", "x", "train"), (2020, "a", "x", "test"), (2021, "b", "x", None)]
    got = {(r["kind"], r["item"]): r["records"] for r in audit.split_audit(spark.createDataFrame(rows, "year int, tile string, crop string, split string")).collect()}
    assert got == {("split", "train"): 1, ("split", "test"): 1, ("year", "2020"): 2, ("year", "2021"): 1, ("overlap", "test&train"): 1, ("unassigned", "unassigned"): 1}


def test_outputs_by_policy(spark):
    files = spark.createDataFrame([("/o/1_2.tif",), ("/o/1_2_20240601.tif",), ("/o/1_2_20240603.tif",), ("/o/11_2.tif",), ("/o/x.txt",)], "path string")
    asked = spark.createDataFrame([("1_2",), ("3_4",)], "tile string")
    every = audit.existing_outputs(asked, files, "all").collect()
    assert sorted((r["tile"], r["date"]) for r in every if r["path"]) == [("1_2", D(1)), ("1_2", D(3))]
    notes = spark.createDataFrame([("1_2", D(5))], "tile string, date date")
    one = {r["tile"]: (r["path"], r["date"]) for r in audit.existing_outputs(asked, files, "latest", notes).collect()}
    assert one == {"1_2": ("/o/1_2.tif", D(5)), "3_4": (None, None)}


def test_listing(spark, tmp_path):
    for p in ("2024_AR/3_4/2024-06-01/B4_2024-06-01.tif", "2024_AR/3_4/2024-06-01/B8A_2024-06-01.tif", "2024_AR/3_4/2024-13-01/B4_2024-13-01.tif",
              "2024_AR/bad/2024-06-01/B4_2024-06-01.tif", "2024_AR/3_4/cdl.tif"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"abc")
    files = L.list_files(spark, str(tmp_path))
    got = sorted((r["year"], r["tile"], r["band"], r["length"]) for r in L.inventory(files).collect())
    assert got == [(2024, "3_4", "B4", 3), (2024, "3_4", "B8A", 3)]
    assert L.inventory(files, "2024-07-01").isEmpty()
    assert L.tile_footprint(files).first()["path"].endswith("cdl.tif")
    assert audit.month_present(L.inventory(files), 2024, 6) and not audit.month_present(L.inventory(files), 2024, 7)


def test_scene_manifest(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    doc = lambda **k: {"id": "s1", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"acquired": "2024-08-13T10:00:00Z"}, **k}
    (tmp_path / "a_metadata.json").write_text(json.dumps(doc()))
    (tmp_path / "b_metadata.json").write_text(json.dumps(doc(id=None)))
    (tmp_path / "c_metadata.json").write_text(json.dumps(doc(geometry={"type": "Polygon", "coordinates": [ring[:3]]})))
    (tmp_path / "d_metadata.json").write_text("nope{")
    got = {r["id"]: r for r in tables.read_scene_manifest(spark, str(tmp_path / "*_metadata.json")).collect()}
    assert set(got) == {"s1", "b"} and got["s1"]["lon_max"] == 2.0 and got["b"]["acquired_day"] == dt.date(2024, 8, 13)
    files = spark.createDataFrame([("/x/s1_3B_AnalyticMS_SR_8b_clip.tif",)], "path string")
    scenes = tables.read_scene_manifest(spark, str(tmp_path / "*_metadata.json"))
    assert [r["id"] for r in tables.scenes_with_raster(scenes, files).collect()] == ["s1"]


def test_model_metrics(spark, tmp_path):
    f = tmp_path / "Sweet Corn" / "metrics.json"
    f.parent.mkdir()
    f.write_text(json.dumps({"train_years": [2020], "test_years": [2024], "test_metrics": {"mae_mean": 45.33}}))
    r = tables.read_model_metrics(spark, str(tmp_path / "*/metrics.json")).first()
    assert (r["crop"], r["test_mae_days"], r["train_years"]) == ("Sweet Corn", 45.3, [2020])


def test_season_summary_files(spark, tmp_path):
    t = spark.createDataFrame(
        [(2021, "1_2", "Corn", D(1), 0.12345, None, 0.5, "Start", "steepest", 3, None, 0.25, "", None, None, None, None, None),
         (2021, "1_2", "Corn", D(6), None, None, None, "End", None, None, 4, None, "GreenupStart", "r", "NDVI", 10, "03-15", "04-30")],
        "year int, tile string, crop string, date date, ndvi double, ndwi double, evi double, harvest string, start_rule string, div_start int, "
        "div_end int, iou double, seeding_event string, greenup_rule string, greenup_source string, seeding_offset_days int, "
        "seeding_window_start string, seeding_window_end string")
    sinks.write_season_summary(t, str(tmp_path / "s"))
    back = tables.read_season_summary(spark, str(tmp_path / "s")).orderBy("Date").collect()
    assert back[0]["NDVI"] == 0.1235 and back[0]["NDWI"] is None and back[0]["Harvest"] == "Start" and back[0]["tile"] == "1_2"
    assert back[1]["SeedingEvent"] == "GreenupStart" and back[1]["seeding_offset_days"] == 10.0 and back[1]["Date"] == D(6)
    old = spark.createDataFrame([("Corn", "2021-01-01", "3")], "Crop string, Date string, div_result_start string")
    assert tables.typed_season_summary(old).first()["div_start"] == 3.0


def test_artifact_round_trip_passes_over_the_readings_once(spark, monkeypatch):
    from fieldtide.plans import relations as R, source_plans

    sf, seen, real = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), R.predictions

    def counted(spark, sf):
        rows = real(spark, sf)

        def tick(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(tick, rows.schema)

    monkeypatch.setattr(R, "predictions", counted)
    assert source_plans.artifact_round_trip(spark, sf).count() > 0
    assert seen.value == real(spark, sf).count()


def test_season_summary_files_do_not_follow_the_tiles(spark, tmp_path):
    t = spark.range(400).selectExpr("cast(2020 + id % 2 as int) AS year", "concat(id, '_0') AS tile", "'Corn' AS crop", "DATE'2021-01-01' AS date", *[
        f"cast(null as {kind}) AS {c}" for c, kind in (("ndvi", "double"), ("ndwi", "double"), ("evi", "double"), ("harvest", "string"), ("start_rule", "string"),
        ("div_start", "int"), ("div_end", "int"), ("iou", "double"), ("seeding_event", "string"), ("greenup_rule", "string"), ("greenup_source", "string"),
        ("seeding_offset_days", "int"), ("seeding_window_start", "string"), ("seeding_window_end", "string"))])
    sinks.write_season_summary(t, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["year=2020", "year=2021"]
    assert len(list((tmp_path / "s").rglob("*.csv"))) < 40
    back = tables.read_season_summary(spark, str(tmp_path / "s"))
    assert back.select("year", "tile").exceptAll(t.select("year", "tile")).isEmpty() and back.count() == 400


def test_farm_summary_and_reports(spark, tmp_path):
    s = spark.createDataFrame([("Corn", "1_2", D(1), None)], "crop string, farm_id string, harvest_start date, harvest_end date").withColumns({
        c: F.lit(None).cast("string") for c in ("greenup_start", "estimated_seeding_date", "seeding_source", "seeding_rule", "seeding_offset_days", "seeding_window_start", "seeding_window_end")})
    sinks.write_farm_summary(s, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns[:3] == ["Crop", "FarmID", "HarvestStart"]
    rep = spark.createDataFrame([("wrote",), ("wrote",), ("empty",)], "status string")
    r = sinks.run_report(rep, {"grid_n": "20"}).first()
    assert (r["wrote"], r["empty"], r["failed"], r["parameters"]) == (2, 1, 0, {"grid_n": "20"})
    sinks.write_run_report(rep, str(tmp_path / "r"), {})


def test_farm_summary_runs_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    s = spark.range(400).repartition(4).selectExpr("cast(2020 + id % 2 as int) AS year", "'Corn' AS crop", "cast(id as string) AS farm_id", *[
        f"cast(null as string) AS {c}" for c in ("harvest_start", "harvest_end", "greenup_start", "estimated_seeding_date", "seeding_source", "seeding_rule",
                                                 "seeding_offset_days", "seeding_window_start", "seeding_window_end")])

    def tick(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    sinks.write_farm_summary(s.mapInArrow(tick, s.schema), str(tmp_path / "f"))
    back = spark.read.option("header", True).csv(str(tmp_path / "f"))
    assert back.count() == 400 and back.select("FarmID").distinct().count() == 400
    assert seen.value == 400


def test_pixel_tables(spark, tmp_path):
    rows = [("1_2", D(1), r, c, 5, None if r else 6, 4) for r in range(2) for c in range(2)] + [("1_2", D(2), 0, 0, 5, None, 4), ("3_4", D(1), 0, 0, 1, 1, 4)]
    px = spark.createDataFrame(rows, "tile string, date date, row int, col int, B4 int, B8 int, scl int")
    X.write_pixels(px, str(tmp_path / "px"))
    got = X.read_pixels(spark, str(tmp_path / "px"), ["B4", "B8"], tiles=["1_2"])
    assert got.count() == 4 and got.select("date").distinct().first()["date"] == D(1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*tile#", plan)
    long = spark.createDataFrame([("t", D(1), 0, 0, "B4", 1), ("t", D(1), 0, 0, "B8", 2), ("t", D(2), 0, 0, "B4", 1)], "tile string, date date, row int, col int, band string, value int")
    assert [(r["B4"], r["B8"]) for r in X.pivot_bands(long, ("B4", "B8")).collect()] == [(1, 2)]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    from fieldtide.operators.observations import mask_pixels
    from fieldtide.operators.quality import monthly_median

    px = spark.range(400).selectExpr("'1_2' tile", "date'2024-06-01' date", "int(id div 20) row", "int(id % 20) col", "int(id) B4", "4 scl")
    X.save_bucketed(px, "bucketed_px", 4, str(tmp_path / "bpx"))
    X.save_bucketed(px.selectExpr("tile", "row", "col", "1 label"), "bucketed_mask", 4, str(tmp_path / "bm"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (mask_pixels(spark.table("bucketed_px"), spark.table("bucketed_mask")), monthly_median(spark.table("bucketed_px"), bands=("B4",))):
            assert df.count() == 400
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bucketed_px", "bucketed_mask"):
            spark.sql(f"DROP TABLE {t}")


def test_ingest_is_exactly_once(spark, tmp_path):
    schema = "year int, tile string, date date, ndvi double"
    src, out, ck = (str(tmp_path / p) for p in ("src", "out", "ck"))
    put = lambda n: spark.createDataFrame([(2024, "a", D(n), 0.5)], schema).write.mode("append").parquet(src)
    put(1)
    from pyspark.sql.types import _parse_datatype_string

    run = lambda: ingest.ingest_observations(spark, src, _parse_datatype_string(schema), out, ck).awaitTermination()
    run(), run()
    assert spark.read.parquet(out).count() == 1
    put(2)
    run()
    assert sorted(r["date"] for r in spark.read.parquet(out).collect()) == [D(1), D(2)]


def test_grids(spark):
    cells = spatial.make_grid(spark)
    assert cells.count() == 400 and cells.filter("tile = '19_19'").first()["lon_max"] == -89.5522
    size = spatial.adaptive_grid_size(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(5.0), 0.3, 0.3, 10)
    assert tuple(spark.range(1).select(size.alias("s")).first()["s"]) == (4, 10)
    default = spatial.adaptive_grid_size(F.lit(-94.7610), F.lit(32.8376), F.lit(-89.5522), F.lit(36.6652), 1.0, 1.0, 30)
    assert tuple(spark.range(1).select(default.alias("s")).first()["s"]) == (20, 20)
    tiles = spark.createDataFrame([("10_2",), ("9_3",), ("9_12",)], "tile string")
    assert [r["tile"] for r in spatial.natural_tile_order(tiles).collect()] == ["9_3", "9_12", "10_2"]
    whole = spatial.subregions(cells.filter("tile = '0_0'"), 1).first()
    assert whole["part"] == "0_0" and whole["lon_min"] == -94.761


def test_dedupe(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "tile string, position int, v string")
    assert {r["tile"]: r["v"] for r in audit.dedupe_keep_first(rows).collect()} == {"a": "x", "b": "z"}


def stream_of(spark, tmp_path, rows, schema):
    """A file stream with one file per row, so that several small batches arrive."""
    from pyspark.sql.types import _parse_datatype_string

    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(_parse_datatype_string(schema)).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streaming_state(spark, tmp_path):
    at = lambda h, day=1: dt.datetime(2024, 6, day, h)
    rows = [("k", at(1), "1", "queued"), ("k", at(5), "2", "running"), ("k", at(3), "3", "failed"), ("m", at(2), "4", "queued")]
    jobs = stream_of(spark, tmp_path, rows, "job_key string, updated_at timestamp, job_id string, state string")
    got = {r["job_key"]: (r["job_id"], r["state"]) for r in run(ingest.latest_job_state(jobs), "latest_jobs", "complete").collect()}
    assert got == {"k": ("2", "running"), "m": ("4", "queued")}


def test_streaming_coverage(spark, tmp_path):
    at = lambda h, day=1: dt.datetime(2024, 6, day, h)
    rows = [(at(1), "a"), (at(2), "a"), (at(3, 2), "a"), (at(5), "b")]
    scenes = stream_of(spark, tmp_path, rows, "ts timestamp, tile string")
    got = {r["date"]: (r["tiles"], r["scenes"]) for r in run(ingest.rolling_coverage(scenes), "coverage", "complete").collect()}
    assert got == {D(1): (2, 3), D(2): (1, 1)}
    landed = ingest.land(ingest.exact_coverage(scenes), str(tmp_path / "seen"), str(tmp_path / "ck"))
    assert landed.count() == 3


def test_display_names(spark):
    from fieldtide.functions.text import safe_crop_folder
    from fieldtide.sources import dimensions

    crops = dimensions.crop_dimension(spark, {"num2class": {26: "Dbl Crop WinWht/Soybeans", 1: "Corn"}, "crop_type": {1: "Corn"}})
    rows = crops.select(safe_crop_folder(F.col("crop")).alias("folder")).unionByName(spark.createDataFrame([("Other-Thing",)], "folder string"))
    got = {r["folder"]: r["crop"] for r in dimensions.with_display_names(rows, crops).collect()}
    assert got == {"Corn": "Corn", "Dbl Crop WinWht-Soybeans": "Dbl Crop WinWht/Soybeans", "Other-Thing": "Other-Thing"}


def test_hot_groups_shrink_before_the_shuffle(spark):
    """One tile holds over a third of the pixels: results stay right, and raw pixels meet partial aggregates only."""
    from fieldtide.operators import observations as O, quality as Q, stats

    n = 30000
    px = spark.range(n).select(
        F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 97)).alias("tile"),
        F.lit(D(1)).alias("date"), (F.col("id") % 300).cast("int").alias("row"), F.floor(F.col("id") / 300).cast("int").alias("col"),
        *[(F.col("id") % 251 + k).cast("int").alias(b) for k, b in enumerate(("B2", "B3", "B4", "B8", "B11"))], F.lit(4).alias("scl"), F.lit(1).alias("label"))
    cases = {
        "means": O.group_date_means(O.with_indices(px), ["tile"]), "clouds": Q.cloud_stats(px), "channels": Q.channel_stats(px, ["B4"]),
        "classes": stats.class_histogram(px, ["tile"]), "values": stats.value_histogram(px, ["tile"], {"v": F.col("B4")}),
    }
    for name, df in cases.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and "Window" not in plan, name
    counts = {r["tile"]: r["pixels"] for r in cases["clouds"].collect()}
    assert counts["hot"] == n * 2 // 5 and sum(counts.values()) == n
    hist = cases["classes"].filter("tile = 'hot'").first()["histogram"]
    assert hist == {"1": n * 2 // 5}
