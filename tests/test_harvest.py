"""The published service goldens, and the reader and writer round trips around them."""

import json

import pytest
from pyspark.sql import functions as F

from fieldtide import schemas
from fieldtide.operators import harvest, spatial, stats
from fieldtide.sources import files as L, sinks, tables

ROWS = """year,tile,crop,pred_start_doy,pred_end_doy,num_observations,model_test_mae_days
2025,0_0,Corn,100,200,20,12.4
2025,0_1,Corn,120,220,30,12.4
2025,0_1,Cotton,150,250,25,18.7
"""
BOUNDS = {"0_0": [-92.20, 33.00, -92.10, 33.10], "0_1": [-92.10, 33.00, -92.00, 33.10]}


@pytest.fixture()
def artifact(tmp_path):
    folder = tmp_path / "2025" / "1year" / "all_indices"
    folder.mkdir(parents=True)
    (folder / "predictions.csv").write_text(ROWS)
    (folder / "metadata.json").write_text(json.dumps({"model": "hybrid", "tile_bounds_wgs84": BOUNDS}))
    return tmp_path, folder


def load(spark, folder):
    rows, bad = tables.read_predictions(spark, str(folder / "predictions.csv"), strict=True)
    tiles, wrong = tables.read_tile_bounds(spark, str(folder / "metadata.json"))
    assert bad.count() == 0 and wrong.count() == 0
    return rows, tiles


def boxes(spark, *rows):
    return spark.createDataFrame(rows, schemas.BBOX_REQUEST)


def test_info_lists_the_legacy_layout(spark, artifact):
    root, folder = artifact
    found = L.available_years(L.list_files(spark, str(root)), "1year", "all_indices", "predictions.csv").collect()
    assert [r["year"] for r in found] == [2025]
    _, tiles = load(spark, folder)
    per_year, ready = harvest.artifact_summary(tiles.withColumns({"year": F.lit(2025), "model": F.lit("hybrid")}))
    assert per_year.first()["tile_count"] == 2 and ready.first()["ready"] is True


def test_box_over_both_tiles(spark, artifact):
    rows, tiles = load(spark, artifact[1])
    got = {r["crop"]: r for r in harvest.harvest_by_crop(rows, tiles, boxes(spark, (1, 2025, -92.20, 33.00, -92.00, 33.10))).collect()}
    assert set(got) == {"Corn", "Cotton"}
    assert (got["Corn"]["start_doy"], got["Corn"]["end_doy"], got["Corn"]["median_observations_per_tile"]) == (110, 210, 25)
    assert got["Corn"]["tiles_with_crop"] == 2 and got["Cotton"]["tiles_with_crop"] == 1
    assert got["Corn"]["harvest_start_date"].isoformat() == "2025-04-20"
    assert got["Corn"]["model_test_mae_days"] == 12.4
    report = harvest.harvest_report(harvest.harvest_by_crop(rows, tiles, boxes(spark, (1, 2025, -92.20, 33.00, -92.00, 33.10))))
    assert report.filter("Crop = 'Corn'").first()["Start range (P10-P90)"] == "2025-04-12 to 2025-04-28"


def test_far_corner_is_accepted(spark):
    checked = spatial.region_guard(boxes(spark, (1, 2025, -94.70, 36.40, -94.60, 36.50), (2, 2025, 10.0, 36.4, 11.0, 36.5), (3, 2025, -94.0, 36.5, -94.0, 36.6)))
    got = {r["request_id"]: r["violation"] for r in checked.collect()}
    assert got == {1: None, 2: "outside_region", 3: "empty_box"}


def test_year_without_artifact(spark, artifact):
    rows, tiles = load(spark, artifact[1])
    assert harvest.harvest_by_crop(rows, tiles, boxes(spark, (1, 2024, -92.20, 33.00, -92.00, 33.10))).isEmpty()
    missing = harvest.missing_tiles(rows, tiles, boxes(spark, (1, 2024, -92.20, 33.00, -92.00, 33.10)))
    assert sorted(r["tile"] for r in missing.collect()) == ["0_0", "0_1"]


def test_violations_and_aliases(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        "year,tile,crop,pred_start_doy,pred_end_doy,cnn_num_observations,rnn_num_observations,model_test_mae_days\n"
        "2025, 0_0 ,Corn,10,20,,7,\n2025,,Corn,10,20,1,1,1\n2025,0_1,Corn,0,20,1,1,1\n2025,0_2,Corn,30,20,1,1,1\n"
        "2025,0_3,Corn,1,2,1,1,1\n2025,0_3,Corn,1,2,1,1,1\n2025,0_4,Corn,x,2,1,1,1\n")
    good, bad = tables.read_predictions(spark, str(path))
    row = good.first()
    assert good.count() == 1 and row["tile"] == "0_0" and row["num_observations"] == 7 and row["model_test_mae_days"] is None
    assert sorted(r["violation"] for r in bad.collect()) == [
        "blank_key", "duplicate_key", "duplicate_key", "invalid_doy", "invalid_doy", "start_after_end"]
    with pytest.raises(ValueError):
        tables.read_predictions(spark, str(path), strict=True)
    (tmp_path / "q.csv").write_text("year,tile\n1,2\n")
    with pytest.raises(ValueError, match="missing required"):
        tables.read_predictions(spark, str(tmp_path / "q.csv"))


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 100), ("a", 120), ("b", 7)], "k string, v int")
    got = {r["k"]: r for r in stats.percentile_int(df, ["k"], "v", (10, 50, 90)).collect()}
    assert (got["a"]["p10"], got["a"]["p50"], got["a"]["p90"]) == (102, 110, 118)
    assert (got["b"]["p10"], got["b"]["p90"]) == (7, 7)


def test_percentiles_with_a_hot_key(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    keys = np.where(rng.random(6000) < 0.4, 0, rng.integers(1, 50, 6000))
    vals = rng.integers(1, 367, 6000)
    df = spark.createDataFrame(list(zip(keys.tolist(), vals.tolist())), "k int, v int")
    got = {r["k"]: r for r in stats.percentile_int(df, ["k"], "v", (10, 50, 90)).collect()}
    for k in np.unique(keys):
        v = np.sort(vals[keys == k])
        for q in (10, 50, 90):
            t = q * (len(v) - 1)
            lo, hi, r = int(v[t // 100]), int(v[min(t // 100 + 1, len(v) - 1)]), t % 100
            s = lo * (100 - r) + hi * r
            want = s // 100 + (s % 100 > 50 or (s % 100 == 50 and (s // 100) % 2 == 1))
            assert got[int(k)][f"p{q}"] == want


def test_boxes_on_edges(spark):
    cells = spatial.grid_cells_for_bbox(boxes(spark, (1, 2025, -92.27, 33.05, -92.23, 33.10)))
    assert [r["tile"] for r in cells.collect()] == ["9_1"]
    edge = -94.7610 + 3 * ((-89.5522 + 94.7610) / 20)
    cells = spatial.grid_cells_for_bbox(boxes(spark, (1, 2025, edge, 33.1, edge, 33.1)))
    assert sorted(r["tile"] for r in cells.collect()) == ["2_1", "3_1"]


def test_tiles_intersecting_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)

    def some(n, big):
        lo = rng.uniform([-95, 32], [-89, 37], (n, 2)).round(2)
        hi = lo + rng.uniform(0.01, big, (n, 2)).round(2)
        return [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, hi))]

    t, b = some(300, 0.9), some(40, 2.5) + [(99, -92.0, 33.0, -92.0, 33.0)]
    cols = "lon_min double, lat_min double, lon_max double, lat_max double"
    tiles = spark.createDataFrame([(str(r[0]), *r[1:]) for r in t], "tile string, " + cols)
    bx = spark.createDataFrame(b, "request_id int, " + cols)
    got = [(r["request_id"], int(r["tile"])) for r in spatial.tiles_intersecting(tiles, bx).collect()]
    want = {(q[0], p[0]) for p in t for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_write_predictions(spark, artifact, tmp_path):
    rows, _ = load(spark, artifact[1])
    out = str(tmp_path / "out")
    sinks.write_predictions(rows, out)
    with pytest.raises(Exception):
        sinks.write_predictions(rows, out)
    sinks.write_predictions(rows.filter("crop = 'Corn'"), out, overwrite=True)
    again, bad = tables.read_predictions(spark, out)
    assert again.count() == 2 and bad.count() == 0


def test_artifact_document(spark, artifact, tmp_path):
    rows, tiles = load(spark, artifact[1])
    years = spark.createDataFrame([("Corn", [2020, 2021], [2024]), ("Cotton", [2021, 2022], [2024])], "crop string, train_years array<int>, test_years array<int>")
    doc = harvest.artifact_metadata(rows, rows, tiles, years)
    d = doc.first()
    assert d["trained_years"] == [2020, 2021, 2022] and d["crops"] == ["Corn", "Cotton"] and d["prediction_row_count"] == 3
    assert d["training_note"] == "The selected model was trained on 2020, 2021, 2022 and evaluated on 2024."
    bounds = harvest.artifact_bounds(rows, tiles)
    assert harvest.fold_bounds(doc, bounds).first()["tile_bounds_wgs84"] == BOUNDS and d["supported_region"]["lon_min"] == -92.2
    sinks.write_artifact_metadata(doc, str(tmp_path / "doc"), bounds)
    back, _ = tables.read_tile_bounds(spark, str(tmp_path / "doc" / "tile_bounds"), rows=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted((k, *v) for k, v in BOUNDS.items())
    with pytest.raises(ValueError):
        harvest.require_rows(doc, 1990)


def test_evaluate(spark):
    p = spark.createDataFrame([(1, "a", "Corn", 100, 200), (1, "b", "Corn", 110, 190)], "year int, tile string, crop string, start_doy int, end_doy int")
    t = spark.createDataFrame([(1, "a", "Corn", 110, 210), (1, "b", "Corn", 110, 190)], "year int, tile string, crop string, start_doy int, end_doy int")
    r = harvest.evaluate_windows(p, t).first()
    assert (r["mae_start"], r["mae_end"], r["mae_mean"], r["ordered_pct"]) == (5.0, 5.0, 5.0, 1.0)
    assert r["iou_mean"] == pytest.approx((90 / 110 + 1) / 2)
