import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fieldtide.functions import dates as D, geometry as G, indices as X, text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v):
    return F.lit(v)


def date(text):
    return F.lit(text).cast("date")


def test_indices(spark):
    assert one(spark, X.ndvi(lit(0.5), lit(0.1))) == pytest.approx(0.666667, abs=1e-6)
    assert one(spark, X.ndwi(lit(0.5), lit(0.3))) == pytest.approx(0.25, abs=1e-6)
    assert one(spark, X.evi(lit(0.5), lit(0.1), lit(0.05))) == pytest.approx(0.579710, abs=1e-6)
    assert one(spark, X.ndvi(lit(None).cast("double"), lit(0.1))) is None
    assert one(spark, X.evi(lit(0.9), lit(0.0), lit(0.25))) == 1.0
    assert one(spark, X.finite(lit(float("nan")))) is None
    assert one(spark, X.argmax_class(F.array(lit(0.1), lit(0.7), lit(0.7)))) == 1
    assert one(spark, X.clamp_unsigned(lit(300), 8)) == 255
    assert one(spark, X.reflectance(lit(2500))) == 0.25
    assert one(spark, X.swir_band(lit(None).cast("int"), lit(7))) == 7


def test_mask_policies(spark):
    keep = lambda s, p, w=False: one(spark, X.scl_valid(lit(s).cast("int"), p, w))
    assert [keep(s, "bad") for s in (3, 4, 8, 11, None)] == [False, True, False, False, True]
    assert [keep(s, "keep") for s in (4, 5, 6, 7, 2)] == [True, True, True, True, False]
    assert keep(6, "keep", True) is False
    assert keep(6, "not_water") is False and keep(8, "cloud") is False


def test_palette(spark):
    assert one(spark, X.palette_lookup(lit(3)))["hex"] == "#1e90ff"
    assert one(spark, X.palette_lookup(lit(17)))["name"] == "Background"


@pytest.mark.parametrize("num,want", [(50, 0), (150, 2), (250, 2), (251, 3), (249, 2), (0, 0)])
def test_half_even(spark, num, want):
    assert one(spark, X.round_half_even_ratio(lit(num).cast("bigint"), 100)) == want


def test_days(spark):
    assert one(spark, D.doy_to_date(lit(2023), lit(366))) == dt.date(2023, 12, 31)
    assert one(spark, D.doy_to_date(lit(2024), lit(60))) == dt.date(2024, 2, 29)
    assert [one(spark, D.doy_bin(lit(d))) for d in (1, 5, 6, 366)] == [0, 0, 1, 72]
    inside = lambda d: one(spark, D.in_month_day_window(date(d), lit("12-15"), lit("01-15")))
    assert [inside(d) for d in ("2024-01-10", "2024-12-20", "2024-02-01")] == [True, True, False]
    got = one(spark, D.decode_doy(lit(0.5), lit(0.4)))
    assert (got["start_doy"], got["end_doy"]) == (183, 183)
    assert one(spark, D.encode_doy(lit(None).cast("int"))) == 0.0
    assert one(spark, D.parse_date(lit("2023-02-30"))) is None
    assert one(spark, D.parse_date(lit("2023-2-3"))) is None
    assert one(spark, D.max_doy_for_month(lit(2024), lit(2))) == 60
    assert one(spark, D.previous_month(date("2024-03-31")))["last"] == dt.date(2024, 2, 29)
    assert one(spark, D.pseudo_month_date(lit(2023), lit(2), lit(31))) == dt.date(2023, 2, 28)
    assert one(spark, D.clamp_model_month(lit(2))) == 6
    assert one(spark, D.choose_model_month(lit(None).cast("int"), lit(None).cast("int"), lit(9))) == 9


def test_split_by_month(spark):
    got = one(spark, D.split_by_month(date("2024-01-20"), date("2024-03-02")))
    assert [(r["part_start"].isoformat(), r["part_end"].isoformat()) for r in got] == [
        ("2024-01-20", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    with pytest.raises(Exception, match="period ends before"):
        one(spark, D.split_by_month(date("2024-02-20"), date("2024-01-02")))


def test_iou(spark):
    v = one(spark, D.harvest_iou(date("2019-08-01"), date("2019-09-30"), lit("07-31"), lit("10-15"), lit(2019)))
    assert v == pytest.approx(60 / 76)
    assert one(spark, D.harvest_iou(date("2021-08-01"), date("2021-09-30"), lit("07-31"), lit("10-15"), lit(2019))) == 0.0


def test_output_names(spark):
    assert one(spark, D.date_from_output_name(lit("/a/3_4_20240131.tif"))) == dt.date(2024, 1, 31)
    assert one(spark, D.date_from_output_name(lit("/a/3_4.tif"))) is None
    assert one(spark, D.date_from_output_name(lit("/a/3_4_20241331.tif"))) is None


def test_text(spark):
    assert one(spark, T.to_double_lenient(lit(" 1.5 "))) == 1.5
    assert one(spark, T.to_double_lenient(lit("x"))) is None
    assert one(spark, T.to_double_lenient(lit("inf"))) is None
    assert one(spark, T.safe_crop_folder(lit("Dbl Crop  WinWht/Soybeans"))) == "Dbl Crop WinWht-Soybeans"
    assert one(spark, T.safe_model_name(lit("A/B"))) == "A_B"
    assert one(spark, T.normalize_date_policy(lit(" Similar_Date "))) == "statewide_anchor"
    assert one(spark, T.normalize_date_policy(lit("newest"))) is None
    tag = T.run_tag(lit("2024-01-01"), lit("2024-01-31"), lit(20.0), lit(False))
    assert one(spark, tag) == "2024-01-01_2024-01-31_ct20_mw0"
    assert one(spark, T.harvest_flag(date("2024-01-01"), date("2024-01-01"), date("2024-01-01"))) == "Start"
    assert one(spark, T.seeding_flag(date("2024-01-01"), date("2024-01-01"), date("2024-01-01"))) == "GreenupStart;EstimatedSeedingDate"


def test_fingerprint(spark):
    body = {"year": 2024, "tiles": ["0_1", "2_3"], "name": 'a"b\\c', "force": True, "cloud": None}
    want = hashlib.sha1(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = T.request_fingerprint({
        "year": ("int", lit(2024)), "tiles": ("texts", F.array(lit("2_3"), lit("0_1"))), "name": ("text", lit('a"b\\c')),
        "force": ("bool", lit(True)), "cloud": ("raw", lit(None).cast("int"))})
    assert one(spark, got) == want


def test_geometry(spark):
    box = one(spark, G.parse_bbox(lit("-92, 33,-91,34")))
    assert box["violation"] is None and box["lat_max"] == 34.0
    assert one(spark, G.parse_bbox(lit("-92,33,-91")))["violation"] == "four_numbers_required"
    assert one(spark, G.parse_bbox(lit("-92,95,-91,99")))["violation"] == "latitude_limit"
    m = G.wgs84_to_mercator(lit(-92.0), lit(33.0), lit(-91.0), lit(34.0))
    back = one(spark, G.mercator_to_wgs84(m["x_min"], m["y_min"], m["x_max"], m["y_max"]))
    assert back["lat_max"] == pytest.approx(34.0, abs=1e-9)
    assert one(spark, m)["x_min"] == pytest.approx(-10241393.15, abs=0.01)
    w = one(spark, G.window_for_bounds(lit(1.0), lit(1.0), lit(3.0), lit(2.5), lit(0.0), lit(4.0), lit(1.0), lit(-1.0), lit(10), lit(4)))
    assert (w["col_off"], w["row_off"], w["width"], w["height"], w["valid"]) == (1, 1, 2, 2, True)
    miss = one(spark, G.window_for_bounds(lit(20.0), lit(1.0), lit(30.0), lit(2.5), lit(0.0), lit(4.0), lit(1.0), lit(-1.0), lit(10), lit(4)))
    assert miss["valid"] is False


def test_band_rule(spark):
    names = F.array(lit("Blue"), lit("Green"), lit("Red"))
    none = F.array(lit(""), lit(""), lit(""))
    assert one(spark, T.band_index_rule(names, none, lit(3))) == [3, 2, 1]
    assert one(spark, T.band_index_rule(none, none, lit(8))) == [6, 4, 2]
    assert one(spark, T.band_index_rule(none, none, lit(3))) == [1, 2, 3]
    assert one(spark, T.band_index_rule(none, none, lit(2))) is None
