"""From pixels and a crop mask to per-crop and per-field time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fieldtide.functions import indices as X
from fieldtide.functions.text import harvest_flag, seeding_flag

PIXEL = ("tile", "row", "col")


def mask_pixels(pixels: DataFrame, mask: DataFrame, columns: Sequence[str] = ("label",)) -> DataFrame:
    """Attach the mask's columns to each pixel (equi-join on tile, row, col)."""
    return pixels.join(mask.select(*PIXEL, *columns), list(PIXEL))


def crop_label_filter(
    masked: DataFrame, crops: DataFrame, red: str = "B4", label: str = "label", allowed: Sequence[str] | None = None
) -> DataFrame:
    """Keep pixels of valid crops and add the crop name. A pixel without red signal belongs to no crop.

    ``crops`` is the crop dimension (label, crop, is_crop): a few hundred class codes at most.
    """
    names = crops.filter(F.col("is_crop") & (F.col("label") != 0)).select(F.col("label").alias(label), "crop")
    if allowed is not None:
        names = names.filter(F.col("crop").isin(*allowed))
    alive = masked.filter((F.col(red) != 0) & (F.col(label) != 0))
    return alive.join(names, label)


def with_indices(pixels: DataFrame, swir: str = "B11") -> DataFrame:
    """Adds ``ndvi``, ``ndwi``, ``evi`` from raw band numbers. A value that is not finite becomes null."""
    r = lambda b: X.reflectance(F.col(b))
    return pixels.withColumns({
        "ndvi": X.finite(X.ndvi(r("B8"), r("B4"))), "ndwi": X.finite(X.ndwi(r("B8"), r(swir))),
        "evi": X.finite(X.evi(r("B8"), r("B4"), r("B2"))),
    })


def group_date_means(pixels: DataFrame, key: Sequence[str], policy: str = "bad") -> DataFrame:
    """Mean of each index per key and date over usable pixels.

    A date whose pixels are all masked keeps its row with null means. The averages are partial aggregates, so a key
    holding a third of all pixels still shuffles one row per task.
    """
    ok = X.scl_valid(F.col("scl"), policy)
    return pixels.groupBy(*key, "date").agg(
        *[F.avg(F.when(ok, F.col(v))).alias(v) for v in ("ndvi", "ndwi", "evi")]
    )


def crop_date_means(
    pixels: DataFrame, mask: DataFrame, crops: DataFrame, swir: str = "B11", allowed: Sequence[str] | None = None
) -> DataFrame:
    masked = crop_label_filter(mask_pixels(pixels, mask), crops, allowed=allowed)
    return group_date_means(with_indices(masked, swir), ["tile", "crop"])


def farm_date_means(pixels: DataFrame, farms: DataFrame, swir: str = "B11") -> DataFrame:
    """Per-field means over present values, each index on its own. ``farms`` maps pixels to (crop, farm_id)."""
    joined = pixels.join(farms.select(*PIXEL, "crop", "farm_id"), list(PIXEL))
    return with_indices(joined, swir).groupBy("tile", "crop", "farm_id", "date").agg(
        *[F.avg(v).alias(v) for v in ("ndvi", "ndwi", "evi")]
    )


def rescale_guard(images: DataFrame, key: Sequence[str], value: str, limit: float = 1.5) -> DataFrame:
    """An image whose maximum exceeds ``limit`` is stored as integers and is divided by 10000 as a whole.

    The maximum comes from a partial aggregate joined back, so no image has to fit in one task.
    """
    peak = images.groupBy(*key).agg(F.max(value).alias("_peak"))
    scaled = F.when(F.col("_peak") > limit, F.col(value) / F.lit(10000.0)).otherwise(F.col(value))
    return images.join(peak, list(key)).withColumn(value, scaled).drop("_peak")


def dense_timeline(
    obs: DataFrame, group: Sequence[str] = ("year", "tile"), crop: str = "crop", date: str = "date",
    values: Sequence[str] = ("ndvi", "ndwi", "evi"),
) -> DataFrame:
    """Every crop of a group on every date of that group; a crop without that date gets nulls.

    The output is that grid, so its size is crops per tile times dates per tile.
    """
    g = list(group)
    dates = obs.select(*g, date).distinct()
    names = obs.select(*g, crop).distinct()
    return names.join(dates, g).join(obs.select(*g, crop, date, *values), [*g, crop, date], "left")


def timeline_with_events(
    obs: DataFrame, events: DataFrame, key: Sequence[str], values: Sequence[str] = ("ndvi", "ndwi", "evi")
) -> DataFrame:
    """Observations plus event dates: ``start``, ``end``, ``greenup``, ``seeding`` of each series.

    Event dates without an observation become rows with null indices. Rows with no index at all stay only when an
    event falls on them. Adds the text flags and the settings that summary files carry.
    """
    k = list(key)
    fields = [c for c in events.columns if c not in k]
    dates = F.array_distinct(F.array_compact(F.array("start", "end", "greenup", "seeding")))
    marks = events.select(*k, F.explode(dates).alias("date"), F.struct(*fields).alias("_e"))
    # Events travel as rows of their own dates, so they are computed once and meet the readings by grouping. Readings
    # and marks of a season are hashed together; the grouping and the window below need no further exchange.
    rows = obs.select(*k, "date", *values).unionByName(marks, allowMissingColumns=True).repartition(*[F.col(c) for c in k])
    rows = rows.groupBy(*k, "date").agg(*[F.max(v).alias(v) for v in values], F.max("_e").alias("_e"))
    rows = rows.withColumn("_has", F.count("_e").over(W.partitionBy(*k))).filter("_has > 0")
    rows = rows.select(*k, "date", *values, *[F.col(f"_e.{f}").alias(f) for f in fields])
    h = harvest_flag(F.col("date"), F.col("start"), F.col("end"))
    s = seeding_flag(F.col("date"), F.col("greenup"), F.col("seeding"))
    rows = rows.withColumns({"harvest": h, "seeding_event": s})
    alive = F.coalesce(*[F.col(v) for v in values]).isNotNull() | (F.col("harvest") != "") | (F.col("seeding_event") != "")
    started, seeded = F.col("harvest") == "Start", F.col("seeding_event") != ""
    blank = lambda cond, c: F.when(cond, F.col(c))
    return rows.filter(alive).select(
        *k, "date", *values, "harvest", blank(started, "start_rule").alias("start_rule"),
        blank(started, "div_start").alias("div_start"), blank(F.col("harvest") == "End", "div_end").alias("div_end"),
        blank(started, "iou").alias("iou"), "seeding_event",
        *[blank(seeded, c).alias(c) for c in ("greenup_rule", "greenup_source")],
        blank(seeded, "offset_days").alias("seeding_offset_days"),
        blank(seeded, "window_start").alias("seeding_window_start"),
        blank(seeded, "window_end").alias("seeding_window_end"),
    )


def farm_season_summary(rows: DataFrame, key: Sequence[str] = ("crop", "farm_id"), order: str = "row_no") -> DataFrame:
    """Event rows to one row per field: last flagged date wins, first non-empty setting wins.

    Settings are read only from rows that carry a sowing event.
    """
    events = F.transform(F.split("seeding_event", ";"), F.trim)
    last = lambda cond: F.max_by(F.when(cond, F.col("date")), F.when(cond, F.col(order)))
    seeded = F.trim("seeding_event") != ""

    def first(column: str):
        value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
        cond = seeded & F.col("date").isNotNull() & value.isNotNull()
        return F.min_by(F.when(cond, value), F.when(cond, F.col(order)))

    settings = {
        "seeding_source": "greenup_source", "seeding_rule": "greenup_rule",
        "seeding_offset_days": "seeding_offset_days", "seeding_window_start": "seeding_window_start",
        "seeding_window_end": "seeding_window_end",
    }
    has_date = F.col("date").isNotNull()
    return rows.groupBy(*key).agg(
        last((F.trim("harvest") == "Start") & has_date).alias("harvest_start"),
        last((F.trim("harvest") == "End") & has_date).alias("harvest_end"),
        last(F.array_contains(events, "GreenupStart") & has_date).alias("greenup_start"),
        last(F.array_contains(events, "EstimatedSeedingDate") & has_date).alias("estimated_seeding_date"),
        *[first(src).alias(out) for out, src in settings.items()],
    )


def union_summaries(*tables: DataFrame) -> DataFrame:
    """Per-crop and per-tile summaries as one table; missing columns become null, old header names are aligned."""
    aligned = [t.withColumnRenamed("div_result_start", "div_start").withColumnRenamed("div_result_end", "div_end") for t in tables]
    out = aligned[0]
    for t in aligned[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def row_numbers(rows: DataFrame, key: Sequence[str], date: str = "date") -> DataFrame:
    """Row order inside a summary: by date within the key."""
    return rows.withColumn("row_no", F.row_number().over(W.partitionBy(*key).orderBy(date)))
