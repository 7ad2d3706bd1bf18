"""Season kernel, rank selection, run tables, scoring kernels, inventories, artifacts, sidecars and streams."""

import datetime as dt
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import fieldtide
from fieldtide.functions import series as A
from fieldtide.operators import components, harvest, scoring, seasons as S, spatial, stats
from fieldtide.operators import season_kernel as K
from fieldtide.sources import artifacts, pixels as X, tables
from fieldtide.streaming import ingest

cloudpickle.register_pickle_by_value(fieldtide)


# ---------------------------------------------------------------- seasons

def test_kernel_travels_without_the_package(tmp_path):
    (tmp_path / "k.pkl").write_bytes(cloudpickle.dumps(K._kernel(["k"], ["y"], False, 11, 3, 11)))
    load = "import sys; from pyspark import cloudpickle; cloudpickle.loads(open('k.pkl', 'rb').read()); print('fieldtide' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "False", done.stderr[-400:]


def seasons_of(rng, many):
    for k in range(many):
        n = rng.choice([1, 2, 3, 5, 8, 11, 12, 25, 60])
        days = sorted(rng.sample(range(365), n))
        level = rng.choice([0.0, 0.3, 0.9])
        steps = [level := rng.choice([level, level, rng.choice([0.05, 0.3, 0.6, 0.95, 1.0])]) for _ in days]
        shape = steps if k % 3 else [round(np.sin(d / 365 * 3.1) * rng.choice([0, 1, 1]) + rng.choice([0, 0.05, -0.1]) * rng.random(), rng.choice([1, 2, 9])) for d in days]
        for d, v in zip(days, shape):
            yield f"k{k}", dt.date(2023, 1, 1) + dt.timedelta(d), None if rng.random() < 0.15 else float(v)


def test_kernel_equals_the_column_functions(spark):
    """The same numbers to the last bit, smoothed values and all."""
    df = spark.createDataFrame(list(seasons_of(random.Random(7), 1200)), "k string, date date, v double")
    got = {r["k"]: r for r in K.detected_seasons(df, ["k"], ["v"], arrays=True, min_points=3).collect()}
    g = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("date", "v"))).alias("p"))
    g = g.select("k", F.transform("p", lambda p: p["date"]).alias("dates"), F.transform("p", lambda p: p["v"]).alias("y"), F.size("p").alias("n"))
    g = g.withColumns({"w": A.window_length(F.col("n")), "valid": F.size(F.filter("y", lambda y: y.isNotNull()))})
    g = g.withColumn("f", F.when((F.col("n") >= 3) & (F.col("valid") >= 3), A.fill(F.col("y"))))
    g = g.withColumn("s", A.smooth(F.col("f"), A.weight_matrix(F.col("w")), F.col("w")))
    g = g.withColumns({"d": A.slopes(F.col("s")), "peak": A.first_maximum(F.col("s"))})
    inside = (F.col("peak") > 0) & (F.col("peak") < F.col("n") - 1)
    g = g.withColumn("h", F.when(inside, A.harvest_positions(F.col("s"), F.col("d"), F.col("peak"))))
    g = g.withColumn("r", A.rising_dates(F.col("dates"), F.col("s"), lambda d: F.lit(True)))
    rules = set()
    for r in g.collect():
        mine = got[r["k"]]
        assert mine["dates"] == r["dates"] and mine["n"] == r["n"] and mine["v_valid"] == r["valid"]
        assert mine["v_smooth"] == r["s"]
        at = lambda f: None if r["h"] is None else r["dates"][r["h"][f]]
        assert (mine["v_start"], mine["v_end"]) == (at("start_i"), at("end_i"))
        rule = "insufficient_data" if r["s"] is None else "boundary_fallback" if r["h"] is None else r["h"]["rule"]
        assert mine["v_rule"] == rule
        assert (mine["v_rising"] or []) == (r["r"] or [])
        rules.add(rule)
    assert len(rules) >= 4


def test_kernel_slices_do_not_matter(spark, monkeypatch):
    sizes = np.array([5, 1, 300, 2, 2, 40])
    monkeypatch.setattr(K, "CELLS", 320)
    parts = list(K._slices(sizes))
    assert [a for a, _ in parts][1:] == [b for _, b in parts][:-1] and parts[0][0] == 0 and parts[-1][1] == 6
    assert all(b - a == 1 or (b - a) * sizes[a:b].max() <= 320 for a, b in parts)


def test_daily_rows_need_no_average(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in seasons_of(random.Random(1), 20)], "k string, date date, v double")
    a, b = (sorted(map(tuple, S.detect_harvest(df, ["k"], "v", daily=daily).collect()), key=str) for daily in (True, False))
    assert a == b
    plan = S.detect_harvest(df, ["k"], "v", daily=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---------------------------------------------------------------- ranks

def test_percentiles_of_an_unbounded_column(spark):
    rng = random.Random(3)
    rows = [("a", rng.randrange(-10**15, 10**15)) for _ in range(5000)] + [("b", 7)] * 9 + [(None, k) for k in (4, 1, None)] + [("c", None)]
    got = {r["k"]: tuple(r)[1:] for r in stats.percentile_int(spark.createDataFrame(rows, "k string, v bigint").repartition(6), ["k"], "v", (0, 37, 50, 100)).collect()}
    assert set(got) == {"a", "b", None}
    for key, found in got.items():
        values = sorted(v for k, v in rows if k == key and v is not None)
        expected = []
        for q in (0, 37, 50, 100):
            t = q * (len(values) - 1)
            total = values[t // 100] * (100 - t % 100) + values[min(t // 100 + 1, len(values) - 1)] * (t % 100)
            whole, rest = divmod(total, 100)
            expected.append(whole + (rest > 50 or (rest == 50 and whole % 2)))
        assert found == (len(values), *expected)


def test_ranges_follow_the_rows_and_only_wanted_ones_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 10, raising=False)
    hist = spark.range(400).selectExpr("'a' AS k", "id * 3 AS value", "1L AS freq")
    asked, real = [], type(hist).repartitionByRange
    monkeypatch.setattr(type(hist), "repartitionByRange", lambda self, *a: asked.append(a[0]) or real(self, *a))
    found = stats.values_at_ranks(hist, ["k"], {"mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1})
    assert asked == [max(40, spark.sparkContext.defaultParallelism)]
    assert tuple(found.first()) == ("a", 400, 600, 1197)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_key_runs_in_many_tasks(spark):
    rows = spark.range(400_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("value"), F.lit(1).cast("bigint").alias("freq"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rows.repartitionByRange("k", "value").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in dealt.groupBy("p").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 0.3 * 400_000
        found = stats.values_at_ranks(rows, ["k"], {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ordered = rows.orderBy("value").select("value").toPandas()["value"]
    assert (found["n"], found["low"], found["mid"], found["top"]) == (400_000, ordered[0], ordered[200_000], ordered[399_999])


def test_medians(spark):
    rows = [("x", 1.5, None), ("x", -2.0, float("nan")), ("x", 8.0, 3.0), ("y", 0.1, 1.0), ("y", 0.2, 2.0), ("z", None, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in stats.exact_medians(df, ["k"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {"x": (1.5, 3.0), "y": ((0.1 + 0.2) / 2, 1.5)}
    tiles = spark.createDataFrame([("a", 2.0, 3.0), ("a", 4.0, 5.0), ("b", 9.0, 9.0), (None, 100.0, 100.0)], "crs string, dx double, dy double")
    r = spatial.resolution_check(tiles).first()
    assert (r["res_x"], r["res_y"], r["crs_count"], r["tiles"], r["violation"]) == (4.0, 5.0, 2, 3, "mixed_crs")
    none = spatial.resolution_check(tiles.filter("crs is null")).first()
    assert (none["res_x"], none["crs_count"], none["tiles"], none["violation"]) == (None, 0, 0, "no_tiles")
    assert "median" not in spatial.resolution_check(tiles)._jdf.queryExecution().optimizedPlan().toString().lower()


# ---------------------------------------------------------------- components

def flood(cells):
    label = {}
    for cell in sorted(cells):
        if cell in label:
            continue
        stack = [cell]
        label[cell] = cell
        while stack:
            r, c = stack.pop()
            for other in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if other in cells and cells[other] == cells[cell] and other not in label:
                    label[other] = cell
                    stack.append(other)
    return label


@pytest.mark.parametrize("height, width, density", [(9, 700, 0.9), (60, 60, 0.6), (40, 40, 1.0)])
def test_components_of_random_masks(spark, height, width, density):
    rng = random.Random(height)
    cells = {(r, c): rng.choice([1, 1, 2]) for r in range(height) for c in range(width) if rng.random() < density}
    rows = [(t, r, c, v) for t in ("0_1", "2_3") for (r, c), v in cells.items()] + [("2_3", height + 1, 0, 0)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, label int").repartition(5)
    expected = flood(cells)
    got = components.connected_components(df).collect()
    assert len(got) == 2 * len(cells)
    shift = 1 << 31
    assert all((r["component"] // shift, r["component"] % shift) == expected[r["row"], r["col"]] for r in got)


# ---------------------------------------------------------------- scoring

def test_chunks_are_scored_in_small_batches(spark):
    rows = [("t", k, 0, 3, 4, [float(k)] * 16 + [1.0] * 16) for k in range(50)]
    df = spark.createDataFrame(rows, "tile string, chunk_row int, chunk_col int, h int, w int, x array<float>").coalesce(1)

    def predict(model, x):
        assert x.shape[1:] == (2, 4, 4) and len(x) <= 7 and x.dtype == np.float32
        return np.stack([x[:, 0] + x[:, 1], x[:, 0] * model], axis=1)

    out = scoring.score_chunks(df, lambda: 10, predict, 4, 2, out_bands=("a", "b"), batch_size=7).collect()
    assert len(out) == 50 * 12 and all(r["a"] == r["chunk_row"] + 1 and r["b"] == 10 * r["chunk_row"] for r in out)
    assert {(r["r"], r["c"]) for r in out} == {(r, c) for r in range(3) for c in range(4)}


def test_records_of_one_shape_are_read_as_one_buffer(spark):
    rows = [(2020, f"0_{k}", "Corn" if k % 3 else "Rice", [[k / 100] * 73, [0.0] * 73], 5) for k in range(60)]
    records = spark.createDataFrame(rows, "year int, tile string, crop string, x array<array<float>>, num_observations int").coalesce(1)
    registry = spark.createDataFrame([("Corn", "a", 1.0), ("Rice", "b", 2.0)], "crop string, model_path string, test_mae_days double")

    def predict(model, x):
        assert x.shape[1:] == (2, 73) and len(x) <= 8
        m = x[:, 0].mean(axis=1).astype(float)
        return np.stack([m, m + (0.1 if model == "a" else 0.2)], 1)

    got = {r["tile"]: r for r in scoring.score_records(records, registry, lambda path: path, predict, batch_size=8).collect()}
    for k in range(60):
        r = got[f"0_{k}"]
        low = max(1, round(float(np.float32(k / 100)) * 366))
        assert abs(r["pred_start_doy"] - low) <= 1 and abs(r["pred_end_doy"] - r["pred_start_doy"] - (37 if k % 3 else 73)) <= 1 or r["pred_end_doy"] == 366
    mixed = records.withColumn("x", F.when(F.col("tile") == "0_1", F.slice("x", 1, 1)).otherwise(F.col("x")))
    with pytest.raises(Exception, match="different sizes"):
        scoring.score_records(mixed, registry, lambda path: path, predict).collect()


# ---------------------------------------------------------------- sources

def test_pixels_are_scanned_once(spark, tmp_path):
    rows = [("1_2", dt.date(2024, 5, d), r, 0, 5, None if d == 2 else 6) for d in (1, 2, 3) for r in range(4)]
    path = str(tmp_path / "px")
    X.write_pixels(spark.createDataFrame(rows, "tile string, date date, row int, col int, B4 int, B11 int"), path)
    for inventory in (True, False):
        got = X.read_pixels(spark, path, ["B4", "B11"], start="2024-05-02", inventory=inventory)
        assert sorted({r["date"].day for r in got.collect()}) == [3] and got.count() == 4
        assert sorted({r["date"].day for r in X.read_pixels(spark, path, ["B4"], inventory=inventory).collect()}) == [1, 2, 3]
    plan = X.read_pixels(spark, path, ["B4", "B11"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("B11:int" in line.split("ReadSchema")[1] for line in scans) == 1


@pytest.fixture
def artifact(spark):
    rows = [(2024, f"0_{k}", crop, 100, 200, 9, 1.5) for k in range(3) for crop in ("Corn", "Rice")]
    p = spark.createDataFrame(rows, "year int, tile string, crop string, pred_start_doy int, pred_end_doy int, num_observations int, model_test_mae_days double")
    tiles = spark.createDataFrame([(f"0_{k}", float(k), 0.0, k + 1.0, 1.0) for k in range(3)], "tile string, lon_min double, lat_min double, lon_max double, lat_max double")
    years = spark.createDataFrame([("Corn", [2019], [2020])], "crop string, train_years array<int>, test_years array<int>")
    return p, tiles, lambda rows: harvest.artifact_metadata(rows, rows, tiles, years)


def test_a_reader_sees_whole_artifacts_only(spark, tmp_path, artifact, monkeypatch):
    p, tiles, document = artifact
    path = str(tmp_path / "artifact")
    with pytest.raises(FileNotFoundError):
        artifacts.read_artifact(spark, path)
    corn = p.filter("crop = 'Corn'")
    first = artifacts.publish_artifact(corn, document(corn), tiles, path)
    # A writer that dies between staging and commit leaves the version before.
    monkeypatch.setattr(artifacts, "commit_artifact", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        artifacts.publish_artifact(p, document(p), tiles, path)
    monkeypatch.undo()
    assert artifacts.current_version(spark, path) == first
    # So does one whose parts do not fit each other.
    with pytest.raises(ValueError, match="counts"):
        artifacts.publish_artifact(p, document(corn), tiles, path)
    with pytest.raises(ValueError, match="bounds"):
        artifacts.publish_artifact(p, document(p), tiles.filter("tile <> '0_1'"), path)
    with pytest.raises(ValueError, match="violations"):
        artifacts.publish_artifact(p.withColumn("pred_start_doy", F.lit(900)), document(p), tiles, path)
    rows, doc, bounds = artifacts.read_artifact(spark, path)
    assert rows.count() == 3 and doc.first()["prediction_row_count"] == 3 and bounds.count() == 3
    second = artifacts.publish_artifact(p, document(p), tiles, path)
    rows, doc, bounds = artifacts.read_artifact(spark, path)
    assert artifacts.current_version(spark, path) == second and rows.count() == 6 and doc.first()["crops"] == ["Corn", "Rice"]
    assert {tuple(r) for r in bounds.collect()} == {tuple(r) for r in tiles.collect()}


def test_sidecars(spark, tmp_path):
    for name, text in {
        "1_2.meta.json": json.dumps({"meta_patch": "1_2", "date": "2024-05-06"}), "3_4.meta.json": json.dumps({"date": "2024-07-08"}),
        "5_6.meta.json": "{nope", "7_8.meta.json": json.dumps({"date": "2024-13-45"}), "1_2_20240101.meta.json": json.dumps({"meta_patch": "1_2", "date": "2024-01-01"}),
        "other.json": "[]",
    }.items():
        (tmp_path / name).write_text(text)
    got = {(r["tile"], r["date"]) for r in tables.read_sidecars(spark, str(tmp_path)).collect()}
    assert got == {("1_2", dt.date(2024, 5, 6)), ("3_4", dt.date(2024, 7, 8))}


# ---------------------------------------------------------------- streams

def test_newest_state_comes_from_the_sink(spark, tmp_path):
    rows = [("a", "2024-01-01", "j1", "queued"), ("a", "2024-01-03", "j2", "done"), ("b", "2024-01-01", "j3", "queued"), ("a", "2024-01-02", "j4", "late")]
    schema = "job_key string, updated_at string, job_id string, state string"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ingest.latest_job_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = lambda: {r["job_key"]: (r["job_id"], r["state"]) for r in ingest.keep_latest(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).collect()}
    assert run() == {"a": ("j2", "done"), "b": ("j3", "queued")}
    spark.createDataFrame([("b", "2024-02-01", "j9", "done")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {"a": ("j2", "done"), "b": ("j9", "done")}
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 5


def test_rows_beyond_the_bound_are_dropped(spark, tmp_path):
    # A batch drops what was late before the batch ahead of it began.
    days = [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-20", 1), ("2024-01-21", 1), ("2024-01-01", 99), ("2024-01-18", 2), ("2024-01-30", 1)]
    for d, t in days:
        spark.createDataFrame([(d, t)], "d string, tile int").select(F.col("d").cast("timestamp").alias("ts"), "tile").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, tile int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ingest.land(ingest.rolling_coverage(stream, exact=True), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {str(r["date"]): (r["tiles"], r["scenes"]) for r in out.collect()} == {
        "2024-01-01": (1, 1), "2024-01-02": (1, 1), "2024-01-18": (1, 1), "2024-01-20": (1, 1), "2024-01-21": (1, 1)}
