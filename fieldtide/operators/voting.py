"""Choice of one date among the dates found on several indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide import constants as C
from fieldtide.functions.dates import harvest_iou, month_day_in_year
from fieldtide.operators import seasons


def _rank(rule: Column) -> Column:
    low = F.lower(F.coalesce(rule, F.lit("")))
    return (
        F.when(low.contains("steepest_decline_"), 0).when(low.startswith("threshold"), 1).otherwise(2)
    )


def majority(dates: Column, fallback: Column, kind: str) -> Column:
    """Most frequent non-null date of a small array; ties go to the earliest start or the latest end."""
    sign = -1 if kind == "start" else 1
    valid = F.filter(dates, lambda d: d.isNotNull())
    scored = F.transform(
        valid,
        lambda d: F.struct(
            F.size(F.filter(valid, lambda o: o == d)).alias("votes"),
            (F.unix_date(d) * sign).alias("order"), d.alias("date"),
        ),
    )
    return F.coalesce(F.array_max(scored)["date"], fallback)


def majority_vote(
    candidates: DataFrame, key: Sequence[str], kind: str, date: str = "date",
    fallback: str | None = None, target: str | None = None,
) -> DataFrame:
    """Vote over candidate rows: ``chosen`` and, with a target column, ``div_days``.

    Counts are pre-aggregated per (key, date), so one key with a huge number of candidates does not land in one task.
    """
    carried = [c for c in (fallback, target) if c]
    counted = candidates.groupBy(*key, date).agg(
        F.count(F.lit(1)).alias("_votes"), *[F.first(c).alias(c) for c in carried]
    )
    sign = -1 if kind == "start" else 1
    best = F.max(
        F.when(
            F.col(date).isNotNull(),
            F.struct(F.col("_votes"), (F.unix_date(F.col(date)) * sign).alias("o"), F.col(date).alias("d")),
        )
    )
    voted = counted.groupBy(*key).agg(best.alias("_b"), *[F.first(c, ignorenulls=True).alias(c) for c in carried])
    chosen = F.coalesce(F.col("_b.d"), F.col(fallback)) if fallback else F.col("_b.d")
    out = voted.select(*key, chosen.alias("chosen"), *([target] if target else []))
    if target:
        out = out.withColumn("div_days", F.abs(F.datediff("chosen", target))).drop(target)
    return out


def closest(sources: Column, target: Column, fallback: Column, kind: str) -> Column:
    """Closest-to-target choice over a small array of structs (source, date, rule).

    Without a target the earliest start or latest end wins. On the chosen date the better rule wins, then the source
    name. With no date at all the target itself (gap 0) or the fallback is returned.
    """
    valid = F.filter(sources, lambda s: s["date"].isNotNull())
    sign = 1 if kind == "start" else -1
    scored = F.transform(
        valid,
        lambda s: F.struct(
            F.coalesce(F.abs(F.datediff(s["date"], target)), F.lit(0)).alias("gap"),
            F.when(target.isNotNull(), F.unix_date(s["date"])).otherwise(F.unix_date(s["date"]) * sign).alias("o"),
            _rank(s["rule"]).alias("rank"), s["source"].alias("source"),
            s["rule"].alias("rule"), s["date"].alias("date"),
        ),
    )
    best = F.array_min(scored)
    none = F.coalesce(F.size(valid), F.lit(0)) == 0
    return F.struct(
        F.when(none, F.coalesce(target, fallback)).otherwise(best["date"]).alias("date"),
        F.when(none, "FALLBACK").otherwise(best["source"]).alias("source"),
        F.when(none, "no_valid_dates_all_sources").otherwise(best["rule"]).alias("rule"),
        F.when(target.isNull(), F.lit(None).cast("int")).when(none, 0).otherwise(best["gap"]).alias("div_days"),
    )


def closest_vote(
    candidates: DataFrame, key: Sequence[str], kind: str, date: str = "date", source: str = "source",
    rule: str = "rule", target: str | None = None, fallback: str | None = None,
) -> DataFrame:
    """The same choice over candidate rows, as one partial aggregate per key."""
    sign = 1 if kind == "start" else -1
    goal = F.col(target) if target else F.lit(None).cast("date")
    spare = F.col(fallback) if fallback else F.lit(None).cast("date")
    order = F.when(goal.isNotNull(), F.unix_date(F.col(date))).otherwise(F.unix_date(F.col(date)) * sign)
    entry = F.struct(
        F.coalesce(F.abs(F.datediff(F.col(date), goal)), F.lit(0)).alias("gap"), order.alias("o"),
        _rank(F.col(rule)).alias("rank"), F.col(source).alias("source"), F.col(rule).alias("rule"),
        F.col(date).alias("date"),
    )
    best = candidates.groupBy(*key).agg(
        F.min(F.when(F.col(date).isNotNull(), entry)).alias("_b"),
        F.first(goal, ignorenulls=True).alias("_t"), F.first(spare, ignorenulls=True).alias("_f"),
    )
    none = F.col("_b").isNull()
    return best.select(
        *key,
        F.when(none, F.coalesce("_t", "_f")).otherwise(F.col("_b.date")).alias("chosen"),
        F.when(none, "FALLBACK").otherwise(F.col("_b.source")).alias("source"),
        F.when(none, "no_valid_dates_all_sources").otherwise(F.col("_b.rule")).alias("rule"),
        F.when(F.col("_t").isNull(), F.lit(None).cast("int")).when(none, 0).otherwise(F.col("_b.gap")).alias("div_days"),
    )


def repair_end(start: Column, end: Column, candidates: Column, last_date: Column) -> Column:
    """An end that is missing or before the start becomes the latest candidate not before the start, else the last
    observation if that is not before the start, else the start itself."""
    later = F.array_max(F.filter(candidates, lambda d: d >= start))
    spare = F.when(last_date >= start, last_date).otherwise(start)
    return F.when(end.isNull() | (end < start), F.coalesce(later, spare)).otherwise(end)


def season_events(
    obs: DataFrame, key: Sequence[str], windows: DataFrame, seeding: DataFrame, crop: str = "crop",
    date: str = "date", min_points: int | None = None, gt_year: int | None = None, daily: bool = False,
) -> DataFrame:
    """Harvest start and end, sowing estimate and overlap with the target window: one row per series.

    ``obs`` holds ``ndvi``, ``ndwi``, ``evi``; ``daily`` says that it has one row per key and date already. ``gt_year``
    fixes the year of the target window in the overlap score; by default the year of the data is used. Each season is
    gathered once and detected on all three indices; the votes and the green-up choice are projections of that row.
    """
    indices = ("ndvi", "ndwi", "evi")
    n_min = C.MIN_POINTS if min_points is None else min_points
    rows = seasons.detected_seasons(obs, key, indices, date, min_points=n_min, daily=daily).filter(F.col("ndvi_valid") >= n_min)
    rows = rows.join(windows, crop, "left").join(seasons.sowing_window(seeding), crop, "left")
    grouped = rows.withColumns({
        f"_g_{v}": seasons.first_greenup(F.col(f"{v}_rising"), F.col("first_date")) for v in ("ndvi", "evi")
    })

    year = F.year("first_date")
    ends = F.array(*[F.col(f"{x}_end") for x in indices])
    sources = F.array(*[
        F.struct(F.lit(x.upper()).alias("source"), F.col(f"{x}_start").alias("date"), F.col(f"{x}_rule").alias("rule"))
        for x in indices
    ])
    t_start, t_end = month_day_in_year(year, F.col("start_md")), month_day_in_year(year, F.col("end_md"))
    picked = grouped.withColumns({
        "_v": closest(sources, t_start, F.col("first_date"), "start"),
        "_end0": majority(ends, F.col("last_date"), "end"),
        "_seed": seasons.seeding_from_greenup(F.col("_g_ndvi"), F.col("_g_evi"), F.col("offset_days"), year),
    }).withColumns({
        "start": F.col("_v.date"),
        "end": repair_end(F.col("_v.date"), F.col("_end0"), ends, F.col("last_date")),
        "_t_end": t_end,
    })
    score_year = F.lit(gt_year) if gt_year is not None else year
    iou = F.coalesce(
        harvest_iou(F.col("start"), F.col("end"), F.col("start_md"), F.col("end_md"), score_year), F.lit(0.0)
    )
    return picked.filter(F.col("start").isNotNull()).select(
        *key, "start", "end", F.col("_v.source").alias("source"), F.col("_v.rule").alias("start_rule"),
        F.col("_v.div_days").alias("div_start"), F.abs(F.datediff("_end0", "_t_end")).alias("div_end"),
        iou.alias("iou"),
        F.col("_seed.greenup").alias("greenup"), F.col("_seed.seeding").alias("seeding"),
        F.col("_seed.source").alias("greenup_source"), F.col("_seed.rule").alias("greenup_rule"),
        "offset_days", "window_start", "window_end",
    )
