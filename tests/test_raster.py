import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtide.operators import chunks as K, components as P, quality as Q, raster as Z, scoring, stretch


def image(spark, array, tile="0_0", bands=("v",)):
    a = np.atleast_3d(np.asarray(array))
    rows = [(tile, r, c, *[int(x) for x in a[r, c]]) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "tile string, row int, col int, " + ", ".join(f"{b} int" for b in bands)).repartition(3)


def sizes(spark, h, w, **extra):
    df = spark.createDataFrame([("0_0", h, w)], "tile string, height int, width int")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def grid(df, shape, band="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = r[band]
    return out


RNG = np.random.default_rng(4)
IMG = RNG.integers(0, 256, (9, 7))


@pytest.mark.parametrize("th,tw", [(9, 7), (20, 13), (4, 3), (18, 7)])
def test_nearest(spark, th, tw):
    got = grid(Z.resample_nearest(image(spark, IMG), sizes(spark, 9, 7, target_height=th, target_width=tw)), (th, tw))
    rows = np.floor((np.arange(th) + .5) * 9 / th).astype(int)
    cols = np.floor((np.arange(tw) + .5) * 7 / tw).astype(int)
    assert (got == IMG[np.ix_(rows, cols)]).all()


@pytest.mark.parametrize("th,tw", [(9, 7), (20, 13), (36, 28)])
def test_bilinear(spark, th, tw):
    got = grid(Z.resample_bilinear(image(spark, IMG), sizes(spark, 9, 7, target_height=th, target_width=tw), ["v"]), (th, tw))

    def weights(n, big):
        s = (np.arange(big) + .5) * n / big - .5
        w = np.maximum(0, 1 - np.abs(s[:, None] - np.arange(n)))
        return w / w.sum(axis=1, keepdims=True)

    assert np.allclose(got, weights(9, th) @ IMG @ weights(7, tw).T)


def test_block_average(spark):
    got = grid(Z.block_average(image(spark, IMG), sizes(spark, 9, 7), ["v"], 4), (4, 3))

    def share(n, new):
        lo, hi = np.arange(n) * new / n, (np.arange(n) + 1) * new / n
        t = np.arange(new)[:, None]
        w = np.maximum(0, np.minimum(hi, t + 1) - np.maximum(lo, t))
        return w / w.sum(axis=1, keepdims=True)

    assert np.allclose(got, share(9, 4) @ IMG @ share(7, 3).T)
    same = grid(Z.block_average(image(spark, IMG), sizes(spark, 9, 7), ["v"], 9), (9, 7))
    assert np.allclose(same, IMG)


def test_overviews(spark):
    got = Z.overviews(image(spark, IMG), sizes(spark, 9, 7), ["v"], factors=(2, 4, 8), min_side=2)
    assert sorted({r["factor"] for r in got.select("factor").distinct().collect()}) == [2, 4]
    half = grid(got.filter("factor = 2"), (5, 4))
    assert half[0, 0] == IMG[:2, :2].mean() and half[4, 3] == IMG[8, 6]


def test_mosaic_order_and_nodata(spark):
    a, b = np.full((2, 2), 5), np.array([[0, 7], [7, 7]])
    px = image(spark, a, "0_0").unionByName(image(spark, b, "0_1"))
    heads = spark.createDataFrame(
        [("0_0", 0.0, 2.0, 1.0, -1.0, 0.0, 0.0, 2.0, 2.0), ("0_1", 1.0, 2.0, 1.0, -1.0, 1.0, 0.0, 3.0, 2.0)],
        "tile string, x0 double, y0 double, dx double, dy double, lon_min double, lat_min double, lon_max double, lat_max double")
    box = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 2.0)], "request_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    first = grid(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0), (2, 4))
    last = grid(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0, last=True), (2, 4))
    assert first.tolist() == [[5, 5, 7, 0], [5, 5, 7, 0]] and last.tolist() == [[5, 5, 7, 0], [5, 7, 7, 0]]
    cov = Z.coverage_fraction(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0), ["v"]).first()
    assert cov["coverage"] == 0.75 and cov["partial"] is True
    ext = Z.valid_extent(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0), ["v"], ["request_id"]).first()
    assert (ext["row0"], ext["row1"], ext["col0"], ext["col1"]) == (0, 2, 0, 3)


HEADER = "tile string, x0 double, y0 double, dx double, dy double, lon_min double, lat_min double, lon_max double, lat_max double"


def header(tile, x0, y0, dx, dy, h, w):
    return tile, x0, y0, dx, -dy, x0, y0 - h * dy, x0 + w * dx, y0


def test_tiles_overlap_in_number_order(spark):
    px = image(spark, np.full((2, 2), 3), "10_1").unionByName(image(spark, np.full((2, 2), 8), "2_1"))
    heads = spark.createDataFrame([header(t, 0.0, 2.0, 1.0, 1.0, 2, 2) for t in ("10_1", "2_1")], HEADER)
    box = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "request_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    assert (grid(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0), (2, 2)) == 8).all()
    assert (grid(Z.mosaic(px, heads, box, ["v"], 1.0, 1.0, last=True), (2, 2)) == 3).all()


def test_mosaic_finer_than_its_tiles_has_no_holes(spark):
    px = image(spark, np.array([[1, 2], [3, 4]]))
    heads = spark.createDataFrame([header("0_0", 0.0, 2.0, 1.0, 1.0, 2, 2)], HEADER)
    box = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "request_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    got = grid(Z.mosaic(px, heads, box, ["v"], 0.25, 0.5, dense=False), (4, 8))
    assert (got == np.kron([[1, 2], [3, 4]], np.ones((2, 4)))).all()


def test_mosaic_layers_stay_apart(spark):
    px = image(spark, np.full((1, 1), 5)).withColumn("date", F.lit("a")).unionByName(image(spark, np.full((1, 1), 6)).withColumn("date", F.lit("b")))
    heads = spark.createDataFrame([header("0_0", 0.0, 1.0, 1.0, 1.0, 1, 1)], HEADER)
    box = spark.createDataFrame([(1, d, 0.0, 0.0, 1.0, 1.0) for d in "abc"],
                                "request_id int, date string, lon_min double, lat_min double, lon_max double, lat_max double")
    got = Z.mosaic(px, heads, box, ["v"], 1.0, 1.0, layers=("date",))
    assert {(r["date"], r["v"]) for r in got.collect()} == {("a", 5), ("b", 6), ("c", 0)}


def test_retile_with_two_resolutions(spark):
    # Pixels are twice as wide as high; the cells cut through tile t, and the other starts a quarter pixel off.
    img = np.arange(1, 17).reshape(4, 4)
    px = image(spark, img, "2_0").unionByName(image(spark, np.full((2, 2), 99), "10_0"))
    heads = spark.createDataFrame([header("2_0", 0.0, 4.0, 2.0, 1.0, 4, 4), header("10_0", 7.5, 2.0, 2.0, 1.0, 2, 2)], HEADER)
    region = {"lon_min": 0.0, "lat_min": 0.0, "lon_max": 12.0, "lat_max": 6.0}
    done = spark.createDataFrame([("1_1",)], "cell string")
    out, report = Z.retile(px, heads, ["v"], 2.0, 1.0, region, 3, 2, existing=done)
    got = {(r["cell"], r["row"], r["col"]): r["v"] for r in out.collect()}
    want = {("0_0", r, c): img[r + 1, c] for r in range(3) for c in range(2)}
    want |= {("1_0", r, c): img[r + 1, c + 2] for r in range(3) for c in range(2)}
    want |= {("0_1", 2, c): img[0, c] for c in range(2)}
    want |= {("2_0", r, c): 99 for r in (1, 2) for c in range(2)}
    assert got == want
    assert {r["cell"]: r["status"] for r in report.collect()} == {
        "0_0": "wrote", "1_0": "wrote", "2_0": "wrote", "0_1": "wrote", "1_1": "skipped", "2_1": "empty"}


def test_retile_loses_no_pixel_and_reports_zeros(spark):
    img = RNG.integers(1, 200, (8, 8))
    px = image(spark, img, "0_0").unionByName(image(spark, np.zeros((2, 2)), "5_5"))
    heads = spark.createDataFrame([header("0_0", 0.3, 7.9, 0.5, 0.25, 8, 8), header("5_5", 9.0, 9.0, 0.5, 0.25, 2, 2)], HEADER)
    region = {"lon_min": 0.0, "lat_min": 0.0, "lon_max": 10.0, "lat_max": 10.0}
    out, report = Z.retile(px, heads, ["v"], 0.5, 0.25, region, 5, 5)
    assert sorted(r["v"] for r in out.collect()) == sorted(img.ravel().tolist())
    rows = {r["cell"]: r for r in report.collect()}
    assert len(rows) == 25 and rows["4_4"]["status"] == "empty" and rows["4_4"]["source_pixels"] == 4
    assert sum(r["signal_pixels"] for r in rows.values()) == 64


def test_overlay_uses_one_resolution_and_factor(spark):
    # Two bands with zeros of their own; pixels 2 wide and 1 high on a box of 8 by 2.
    a = np.array([[[10, 0], [20, 4], [30, 4], [40, 4]], [[10, 4], [20, 4], [0, 4], [40, 4]]])
    px = image(spark, a, "s", ("p", "q")).withColumnRenamed("tile", "scene")
    hd = spark.createDataFrame([("s", 1, 0.0, 2.0, 2.0, -1.0, 0.0, 0.0, 8.0, 2.0)], "scene string, order int, " + HEADER.split(", ", 1)[1])
    box = {"lon_min": 0.0, "lat_min": 0.0, "lon_max": 8.0, "lat_max": 2.0}
    full = Z.overlay_scenes(px, hd, ["p", "q"], box)[0]
    assert full.agg(F.max("row"), F.max("col")).first()[:] == (1, 7)  # resolution 1 on both axes
    q = {(r["row"], r["col"]): r["q"] for r in full.collect()}
    assert q[0, 1] == 4 and q[1, 0] == 4  # a zero does not pull its neighbours down
    small = Z.overlay_scenes(px, hd, ["p", "q"], box, max_side=4)[0]
    assert small.agg(F.max("row"), F.max("col")).first()[:] == (0, 3)
    assert dict(small.dtypes)["p"] == "int"


def test_overlay_matches_brute_force(spark):
    s1, s2 = RNG.integers(1, 200, (6, 6)), RNG.integers(0, 200, (4, 4))
    s2[0, 0] = 0
    rows = [("a", r, c, int(s1[r, c])) for r in range(6) for c in range(6)] + [("b", r, c, int(s2[r, c])) for r in range(4) for c in range(4)]
    px = spark.createDataFrame(rows, "scene string, row int, col int, v int")
    heads = [("a", 1, 0.0, 6.0, 1.0, -1.0, 0.0, 0.0, 6.0, 6.0), ("b", 2, 2.0, 6.0, 1.0, -1.0, 2.0, 2.0, 6.0, 6.0), ("far", 3, 50.0, 60.0, 1.0, -1.0, 50.0, 56.0, 54.0, 60.0)]
    hd = spark.createDataFrame(heads, "scene string, order int, x0 double, y0 double, dx double, dy double, lon_min double, lat_min double, lon_max double, lat_max double")
    box = {"lon_min": 0.0, "lat_min": 0.0, "lon_max": 6.0, "lat_max": 6.0}
    out, skipped = Z.overlay_scenes(px, hd, ["v"], box)
    want = s1.astype(float)
    for r in range(4):
        for c in range(4):
            if s2[r, c] > 0:
                want[r, c + 2] = s2[r, c]
    assert np.allclose(grid(out, (6, 6)), want)
    assert {r["scene"]: r["reason"] for r in skipped.collect()} == {"far": "outside_box"}
    half, _ = Z.overlay_scenes(px.filter("scene = 'a'"), hd.filter("scene = 'a'"), ["v"], box, max_side=3)
    assert half.count() == 9


def test_display_and_percentile_stretch(spark):
    a = RNG.integers(0, 4000, (12, 12, 2))
    a[:, :2] = 0
    got = stretch.percentile_stretch(image(spark, a, bands=("p", "q")), ["p", "q"], ["tile"])
    for k, b in enumerate("pq"):
        lo, hi = np.percentile(a[..., k], [2, 98]).round(2)
        assert (grid(got, (12, 12), b) == np.floor(np.clip((a[..., k] - lo) / (hi - lo), 0, 1) * 255)).all()
    shown = stretch.display_stretch(image(spark, a, bands=("p", "q")), ["p", "q"], ["tile"])
    ok = (a > 0).any(axis=2)
    lo, hi = np.percentile(a[..., 0][ok], [2, 98]).round(2)
    want = np.where(ok, np.floor(np.clip((a[..., 0] - lo) / (hi - lo), 0, 1) * 255), 0)
    assert np.abs(grid(shown, (12, 12), "p") - want).max() <= 1
    flat = image(spark, np.full((5, 5), 9))
    assert (grid(stretch.display_stretch(flat, ["v"], ["tile"]), (5, 5)) == 9).all()
    assert (grid(stretch.percentile_stretch(flat, ["v"], ["tile"]), (5, 5)) == 0).all()


def test_chunks_cover_and_blend(spark):
    positions = lambda n, t, s: spark.range(1).select(K.chunk_positions(F.lit(n), t, s).alias("p")).first()["p"]
    assert positions(100, 64, 48) == [0, 36] and positions(50, 64, 48) == [0]
    assert positions(10, 4, 3) == [0, 3, 6]
    c = K.chunk_pixels(image(spark, IMG), sizes(spark, 9, 7), 4, 1)
    got = {(r["chunk_row"], r["chunk_col"], r["r"], r["c"]): r["v"] for r in c.collect()}
    want = {(a, b, r, q): int(IMG[a + r, b + q]) for a in (0, 3, 5) for b in (0, 3) for r in range(4) for q in range(4)}
    assert got == want
    assert (grid(K.weighted_blend(c, 4, ["v"]), (9, 7)) == IMG).all()
    with pytest.raises(ValueError):
        K.chunk_pixels(image(spark, IMG), sizes(spark, 9, 7), 4, 4)


@pytest.mark.parametrize("shape,size", [((3, 3), 5), ((2, 3), 9), ((1, 3), 4), ((4, 4), 4)])
def test_padding_matches_numpy(spark, shape, size):
    a = RNG.integers(0, 99, shape)
    c = K.pad_chunks(K.chunk_pixels(image(spark, a), sizes(spark, *shape), size), size)
    got = np.full((size, size), -1)
    for r in c.collect():
        got[r["r"], r["c"]] = r["v"]
        assert r["padded"] == (r["r"] >= shape[0] or r["c"] >= shape[1])
    mode = "reflect" if min(shape) > 1 else "edge"
    assert (got == np.pad(a, [(0, size - shape[0]), (0, size - shape[1])], mode=mode)).all()
    assert c.count() == size * size


def test_weights(spark):
    rows = spark.range(8).select(K.chunk_weight(F.col("id"), F.lit(3), 8).alias("w")).collect()
    ramp = np.maximum(np.hanning(8), 1e-3)
    assert np.allclose([r["w"] for r in rows], ramp * ramp[3])


def label_by_search(mask):
    out, seen = {}, set()
    for r in range(mask.shape[0]):
        for c in range(mask.shape[1]):
            if mask[r, c] == 0 or (r, c) in seen:
                continue
            todo, group = [(r, c)], []
            seen.add((r, c))
            while todo:
                p = todo.pop()
                group.append(p)
                for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and q not in seen and mask[q] == mask[r, c]:
                        seen.add(q)
                        todo.append(q)
            for p in group:
                out[p] = (r, c)
    return out


def snake(n):
    """One component holding most pixels of the image: a long winding path."""
    a = np.zeros((n, n), int)
    a[::2] = 1
    for k, r in enumerate(range(1, n, 2)):
        a[r, 0 if k % 2 else n - 1] = 1
    return a


@pytest.mark.parametrize("mask", [snake(21), RNG.integers(0, 3, (16, 16)), np.ones((6, 6), int)], ids=["snake", "noise", "solid"])
def test_components_match_search(spark, mask):
    got = P.connected_components(image(spark, mask, bands=("label",)))
    want = label_by_search(mask)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        root = want[(r["row"], r["col"])]
        # The component id names the run of its first pixel in scan order.
        assert (r["component"] >> 31, r["component"] % (1 << 31)) == root


def test_farms_collide(spark):
    mask = np.zeros((5, 9), int)
    mask[0, :4] = 1
    mask[2, :4] = 1
    mask[4, 0:2] = 1
    comp = P.connected_components(image(spark, mask, bands=("label",)))
    heads = spark.createDataFrame([("0_0", -0.9, 0.9, 0.1, -0.1)], "tile string, x0 double, y0 double, dx double, dy double")
    found = P.farms(comp, heads, 3).collect()
    assert len(found) == 1 and found[0]["farm_id"] == "0_0" and found[0]["centre_row"] == 2.0


def test_quality_rules_differ(spark):
    rows = [("t", 1, s, b, b, b) for s, b in ((0, 0), (0, 0), (9, 5), (4, 5), (4, 0), (4, 5))]
    px = spark.createDataFrame(rows, "tile string, date int, scl int, B2 int, B3 int, B4 int")
    s = Q.cloud_stats(px).first()
    assert s["cloud_fraction"] == pytest.approx(1 / 6) and s["scl_cloud_ratio"] == 0.25 and s["blank_fraction"] == 0.5
    assert Q.quality_gate(px, 1 / 6, 0.5).count() == 6 and Q.quality_gate(px, 0.1, None).count() == 0
    e = Q.quality_gate_export(px, 0.25, 0.4).first()
    assert e["reason"] == "black" and e["keep"] is False
    assert Q.quality_gate_export(px.withColumn("scl", F.lit(0)), 0.9, None).first()["scl_cloud_ratio"] == 1.0


def test_score_records_and_chunks(spark):
    recs = spark.createDataFrame(
        [(2021, f"{k}_0", "A/B" if k % 3 else "C", [[0.1 * k] * 73, [1.0] * 73], k) for k in range(10)],
        "year int, tile string, crop string, x array<array<float>>, num_observations int")
    registry = scoring.model_paths(spark.createDataFrame([("A/B",)], "crop string"), "/m").withColumn("test_mae_days", F.lit(3.5))
    ready, skipped = scoring.score_ready(recs, registry)
    assert [tuple(r) for r in skipped.collect()] == [("C", 4)]

    def load(path):
        assert path == "/m/A_B/best_model.pt"
        return 0.25

    out = scoring.score_records(ready, registry, load, lambda m, x: np.stack([m + 0 * x[:, 0, 0], m * x[:, 0, 0]], 1))
    got = {r["tile"]: r for r in out.collect()}
    assert len(got) == 6 and got["1_0"]["pred_start_doy"] == 92 and got["1_0"]["pred_end_doy"] == 92 and got["8_0"]["model_test_mae_days"] == 3.5

    padded = K.pad_chunks(K.chunk_pixels(image(spark, IMG), sizes(spark, 9, 7), 4), 4)
    arrays = K.chunk_arrays(padded, ["v"])
    scores = lambda m, x: np.concatenate([x * 0 + 100, x], axis=1)
    out = scoring.score_chunks(arrays, lambda: None, scores, 4, 1, classes=True)
    assert (grid(K.stitch_chunks(out, 4, 0, ["value"]), (9, 7), "value") == (IMG > 100)).all()
