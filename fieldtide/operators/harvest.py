"""Harvest windows for map boxes from precomputed predictions, and artifact summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide.functions.dates import doy_to_date
from fieldtide.operators import spatial, stats


def predictions_for_boxes(predictions: DataFrame, tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Predictions of each request's year in the tiles its box touches. Adds ``request_id``."""
    pairs = spatial.tiles_intersecting(tiles, boxes, box_cols=("request_id", "year"))
    return predictions.join(pairs, ["year", "tile"])


def harvest_by_crop(predictions: DataFrame, tiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per request and crop: median start and end with their 10-90 ranges as days and dates, number of tiles, median
    observation count, and the model error of the first tile that has one.

    Percentiles come from value histograms: days have at most 366 values, so no group is ever collected. One pass
    over the joined rows feeds histogram and counts alike.
    """
    rows = predictions_for_boxes(predictions, tiles, boxes)
    key = ["request_id", "year", "crop"]
    # The joined rows shuffle once, as counts per value: at most 366 per measure, key and task.
    whole = lambda name, c: F.struct(F.lit(name).alias("measure"), F.col(c).cast("bigint").alias("value"))
    measures = F.array(whole("start", "pred_start_doy"), whole("end", "pred_end_doy"), whole("obs", "num_observations"))
    mae = F.when(F.col("model_test_mae_days").isNotNull(), F.struct("tile", "model_test_mae_days"))
    hist = rows.select(*key, mae.alias("_mae"), F.inline(measures)).filter("value is not null").groupBy(
        *key, "measure", "value"
    ).agg(F.count(F.lit(1)).alias("freq"), F.min("_mae").alias("_mae"))
    pct = stats.histogram_percentiles(hist, key, (10, 50, 90), carry=["_mae"])
    pick = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    wide = pct.groupBy(*key).agg(
        *[pick(m, f"p{q}").cast("int").alias(f"{m}_p{q}") for m in ("start", "end") for q in (10, 50, 90)],
        pick("obs", "p50").cast("int").alias("median_observations_per_tile"),
        pick("start", "n").alias("tiles_with_crop"), F.min("_mae").alias("_mae"),
    )
    end = F.greatest("start_p50", "end_p50")
    as_date = lambda c: doy_to_date(F.col("year"), c)
    return wide.select(
        *key, F.col("start_p50").alias("start_doy"), end.alias("end_doy"),
        as_date(F.col("start_p50")).alias("harvest_start_date"), as_date(end).alias("harvest_end_date"),
        as_date(F.col("start_p10")).alias("start_date_p10"), as_date(F.col("start_p90")).alias("start_date_p90"),
        as_date(F.col("end_p10")).alias("end_date_p10"), as_date(F.col("end_p90")).alias("end_date_p90"),
        "tiles_with_crop", "median_observations_per_tile",
        F.round(F.col("_mae.model_test_mae_days"), 1).alias("model_test_mae_days"),
    )


def missing_tiles(predictions: DataFrame, tiles: DataFrame, boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tiles of each request's box without any prediction in the request's year; with ``by`` (such as crop), without one
    of each of the values that these columns take in that year."""
    pairs = spatial.tiles_intersecting(tiles, boxes, box_cols=("request_id", "year"))
    have = predictions.select("year", "tile", *by).distinct()
    if by:
        pairs = pairs.join(predictions.select("year", *by).distinct(), "year")
    return pairs.join(have, ["year", "tile", *by], "left_anti").select("request_id", "year", "tile", *by)


def predictions_for_tiles(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """Semi-join on year and tile."""
    return predictions.join(selected, ["year", "tile"], "left_semi")


def artifact_metadata(
    predictions: DataFrame, records: DataFrame, tiles: DataFrame, crop_years: DataFrame, key: Sequence[str] = ("year",)
) -> DataFrame:
    """One document per year: counts, crops, training years, note and region.

    ``crop_years`` has ``crop, train_years, test_years``. Lists hold crops and years only; tile bounds stay rows, see
    :func:`artifact_bounds`.
    """
    k = list(key)
    per_tile = predictions.groupBy(*k, "tile", "crop").agg(F.count(F.lit(1)).alias("_n"))
    crops = per_tile.groupBy(*k, "crop").agg(F.sum("_n").alias("_n")).join(crop_years, "crop", "left")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<int>"))))))
    by_crop = crops.groupBy(*k).agg(
        F.sum("_n").alias("prediction_row_count"), F.count(F.lit(1)).alias("crop_count"),
        F.array_sort(F.collect_list("crop")).alias("crops"),
        union("train_years").alias("trained_years"), union("test_years").alias("evaluated_years"),
    )
    by_tile = artifact_bounds(per_tile, tiles, key).groupBy(*k).agg(
        F.count(F.lit(1)).alias("tile_count"),
        F.struct(
            F.min("lon_min").alias("lon_min"), F.min("lat_min").alias("lat_min"),
            F.max("lon_max").alias("lon_max"), F.max("lat_max").alias("lat_max"),
        ).alias("supported_region"),
    )
    inputs = records.groupBy(*k).agg(F.count(F.lit(1)).alias("input_record_count"))
    note = F.concat(
        F.lit("The selected model was trained on "), F.array_join("trained_years", ", "),
        F.lit(" and evaluated on "), F.array_join("evaluated_years", ", "), F.lit("."),
    )
    return by_crop.join(by_tile, k).join(inputs, k, "left").withColumn("training_note", note)


def artifact_bounds(predictions: DataFrame, tiles: DataFrame, key: Sequence[str] = ("year",)) -> DataFrame:
    """Bounds of every tile that has a prediction, one row per key and tile."""
    have = predictions.select(*key, "tile").distinct()
    return have.join(tiles, "tile", "left").select(*key, "tile", "lon_min", "lat_min", "lon_max", "lat_max")


def fold_bounds(doc: DataFrame, bounds: DataFrame, key: Sequence[str] = ("year",)) -> DataFrame:
    """The document with its bounds as one map, as small services read it.

    One document holds one key's tiles, however many; ``artifact_bounds`` keeps them as rows where that is too large.
    """
    box = F.array("lon_min", "lat_min", "lon_max", "lat_max")
    entry = F.when(F.col("lon_min").isNotNull(), F.struct(F.col("tile").alias("tile"), box.alias("bounds")))
    maps = bounds.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tile_bounds_wgs84"))
    return doc.join(maps, list(key), "left")


def require_rows(metadata: DataFrame, year: int) -> DataFrame:
    """The document of one year; raises when no prediction exists for it."""
    doc = metadata.filter(F.col("year") == year)
    if doc.isEmpty():
        raise ValueError(f"no harvest predictions for {year}")
    return doc


def artifact_summary(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per year: model, tiles, region, ready flag; one row: whether every year is ready).

    ``artifacts`` has ``year, tile, model`` and nullable bounds, one row per tile.
    """
    known = F.col("lon_min").isNotNull()
    per_year = artifacts.groupBy("year").agg(
        F.first("model", ignorenulls=True).alias("model"), F.count_if(known).alias("tile_count"),
        *[F.min(c).alias(c) for c in ("lon_min", "lat_min")], *[F.max(c).alias(c) for c in ("lon_max", "lat_max")],
    ).withColumn("ready", F.col("tile_count") > 0)
    return per_year, per_year.agg(F.coalesce(F.bool_and("ready"), F.lit(False)).alias("ready"))


def prediction_violations(predictions: DataFrame) -> DataFrame:
    """Rows breaking a rule, with the first rule broken: blank keys, days out of range, order, duplicate keys."""
    checked = with_violation(predictions)
    return checked.filter(F.col("violation").isNotNull())


def with_violation(predictions: DataFrame) -> DataFrame:
    """Adds ``violation``. Duplicates are found by a partial count joined back, not by a window over the key."""
    key = ["year", "tile", "crop"]
    copies = spatial.duplicate_keys(predictions, key)
    marked = predictions.join(copies, key, "left")
    return marked.withColumn("violation", _rules()).drop("copies")


def _rules() -> Column:
    start, end = F.col("pred_start_doy"), F.col("pred_end_doy")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(F.col("year").isNull(), "invalid_year").when(blank("tile") | blank("crop"), "blank_key")
        .when(F.coalesce(~start.between(1, 366), F.lit(True)) | F.coalesce(~end.between(1, 366), F.lit(True)), "invalid_doy")
        .when(start > end, "start_after_end").when(F.col("copies") > 1, "duplicate_key")
    )


def sort_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy("crop", "tile")


def evaluate_windows(predicted: DataFrame, truth: DataFrame, key: Sequence[str] = ("year", "tile", "crop"),
                     by: Sequence[str] = ("crop",)) -> DataFrame:
    """Mean absolute start and end error in days, their mean, mean overlap of the two windows and the share of
    predictions whose start is not after their end."""
    t = truth.select(*key, F.col("start_doy").alias("_ts"), F.col("end_doy").alias("_te"))
    rows = predicted.join(t, list(key))
    ds, de = F.abs(F.col("start_doy") - F.col("_ts")), F.abs(F.col("end_doy") - F.col("_te"))
    inter = F.greatest(F.least(F.col("end_doy"), F.col("_te")) - F.greatest(F.col("start_doy"), F.col("_ts")), F.lit(0))
    union = F.greatest(F.col("end_doy"), F.col("_te")) - F.least(F.col("start_doy"), F.col("_ts"))
    iou = F.try_divide(inter.cast("double"), union.cast("double"))
    ordered = (F.col("start_doy") <= F.col("end_doy")).cast("int")
    return rows.groupBy(*by).agg(
        F.avg(ds).alias("mae_start"), F.avg(de).alias("mae_end"), F.avg(iou).alias("iou_mean"),
        F.avg(ordered).alias("ordered_pct"), F.count(F.lit(1)).alias("records"),
    ).withColumn("mae_mean", (F.col("mae_start") + F.col("mae_end")) / 2)


def harvest_report(result: DataFrame) -> DataFrame:
    """User table with text ranges and readable headings."""
    to = lambda a, b: F.concat_ws(" to ", F.col(a).cast("string"), F.col(b).cast("string"))
    return result.select(
        F.col("crop").alias("Crop"), F.col("harvest_start_date").alias("Harvest start"),
        F.col("harvest_end_date").alias("Harvest end"), F.col("start_doy").alias("Start DOY"),
        F.col("end_doy").alias("End DOY"), F.col("tiles_with_crop").alias("Tiles"),
        to("start_date_p10", "start_date_p90").alias("Start range (P10-P90)"),
        to("end_date_p10", "end_date_p90").alias("End range (P10-P90)"),
        F.col("model_test_mae_days").alias("Test MAE (days)"),
    )
