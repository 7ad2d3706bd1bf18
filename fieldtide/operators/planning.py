"""Choice of acquisition dates over a set of tiles.

``quality`` tables hold one row per tile and date with a ``valid`` flag (see ``quality.gate_flags``). All operators
plan any number of periods at once: ``plan`` columns name the period, for instance the month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide import constants as C

PLAN = ("month",)


def valid_dates(quality: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Distinct usable (tile, date) pairs. An unreadable date (null flag) is not usable."""
    return quality.filter(F.coalesce(F.col("valid"), F.lit(False))).select(*plan, "tile", "date").distinct()


def date_coverage(valid: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Number of tiles per usable date; ``valid`` has one row per tile and date."""
    return valid.groupBy(*plan, "date").agg(F.count(F.lit(1)).alias("tiles"))


def anchor_dates(coverage: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """The date with most tiles per period, the latest one on ties. At most one row per period."""
    best = F.max(F.struct("tiles", "date"))
    return coverage.groupBy(*plan).agg(best.alias("_b")).select(
        *plan, F.col("_b.date").alias("anchor_date"), F.col("_b.tiles").alias("anchor_tiles")
    )


def _nearest(date: Column, goal: Column) -> Column:
    """Sort key: gap in days, then the later date."""
    return F.struct(F.abs(F.datediff(date, goal)).alias("gap"), (-F.unix_date(date)).alias("late"), date.alias("date"))


def nearest_date(left: DataFrame, candidates: DataFrame, on: Sequence[str], goal: str = "goal",
                 key: Sequence[str] | None = None) -> DataFrame:
    """For each left row the candidate date nearest in either direction; ties go to the later date.

    Candidates are one row per join key and date, so a left row meets at most the dates of its own tile. The choice is
    a partial aggregate over the join output.
    """
    ident = list(key or left.columns)
    joined = left.join(candidates.select(*on, F.col("date").alias("_cand")), list(on), "left")
    best = F.min(F.when(F.col("_cand").isNotNull(), _nearest(F.col("_cand"), F.col(goal))))
    return joined.groupBy(*ident).agg(best.alias("_b")).select(
        *ident, F.col("_b.date").alias("date"), F.col("_b.gap").alias("gap_days")
    )


def planned_quality(tiles: DataFrame, quality: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """Quality rows of the planned tiles that have a data folder: only these count towards coverage."""
    return quality.join(tiles.filter("known").select(*plan, "tile"), [*plan, "tile"], "left_semi")


def anchor_plan(tiles: DataFrame, quality: DataFrame, plan: Sequence[str] = PLAN) -> DataFrame:
    """One row per period and tile: chosen date, gap to the anchor, and the status of the tile.

    ``tiles`` must list every tile of the area with its period columns, and ``known`` tells whether the tile has any
    data folder at all: the anchor depends on all of these and on no other tile, so pass the whole grid even when a few
    tiles are asked.
    """
    p = list(plan)
    per_tile = planned_quality(tiles, quality, plan).groupBy(*p, "tile", "date").agg(F.max(F.coalesce("valid", F.lit(False))).alias("valid"))
    coverage = date_coverage(per_tile.filter("valid"), plan)
    anchors = anchor_dates(coverage, plan)
    # One anchor per period: a handful of rows, bounded by the number of periods planned in this call.
    dated = per_tile.join(anchors, p, "left")
    best = F.min(F.when(F.col("valid"), _nearest(F.col("date"), F.col("anchor_date"))))
    chosen = dated.groupBy(*p, "tile").agg(best.alias("_b"), F.first("anchor_date").alias("anchor_date"))
    rows = tiles.join(chosen.withColumn("_any", F.lit(True)), [*p, "tile"], "left")
    status = (
        F.when(~F.col("known"), "meta_patch_missing").when(F.col("_any").isNull(), "no_dates_in_month")
        .when(F.col("_b").isNull(), "no_valid_observation").otherwise("valid_tiles")
    )
    usable = F.col("known") & F.col("_b").isNotNull()
    return rows.select(
        *p, "tile", status.alias("status"), F.when(usable, F.col("_b.date")).alias("date"),
        F.when(usable, F.col("_b.gap")).alias("gap_days"), F.when(usable, F.col("anchor_date")).alias("anchor_date"),
    )


def plan_summary(planned: DataFrame, coverage: DataFrame, plan: Sequence[str] = PLAN, top: int = 10) -> DataFrame:
    """One row per period: anchor, coverage, counts by assignment and status, top dates, histogram of gaps.

    A period without any usable date has zero counts and a null anchor.
    """
    p = list(plan)
    has = F.col("date").isNotNull()
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    # Gap counts are reduced per gap first; a period has at most a year of different gaps.
    gaps = planned.filter(has).groupBy(*p, "gap_days").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col("gap_days").cast("string").alias("gap"), F.col("_n").alias("tiles"))
    gap_map = gaps.groupBy(*p).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("gap_days_hist"))
    counts = planned.groupBy(*p).agg(
        F.max("anchor_date").alias("anchor_date"), F.count_if(has).alias("planned_tiles"),
        F.count_if(has & (F.col("gap_days") == 0)).alias("anchor_assigned_tiles"),
        F.count_if(has & (F.col("gap_days") > 0)).alias("fallback_assigned_tiles"),
        *[status(s) for s in ("meta_patch_missing", "no_dates_in_month", "no_valid_observation", "valid_tiles")],
    )
    tops = top_dates(coverage, plan, top).groupBy(*p).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "date", "tiles"))), lambda r: F.struct(r["date"], r["tiles"])
        ).alias("top_dates"),
        F.max("tiles").alias("anchor_coverage_tiles"),
    )
    return counts.join(tops, p, "left").join(gap_map, p, "left").withColumn(
        "anchor_coverage_tiles", F.coalesce("anchor_coverage_tiles", F.lit(0).cast("bigint"))
    )


def top_dates(coverage: DataFrame, plan: Sequence[str] = PLAN, n: int = 10) -> DataFrame:
    """The ``n`` best covered dates per period, later dates first on ties, with their rank."""
    w = W.partitionBy(*plan).orderBy(F.col("tiles").desc(), F.col("date").desc())
    return coverage.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sample_dates(dates: DataFrame, key: Sequence[str] = ("tile",), date: str = "date",
                 per_month: dict[int, int] = C.DATES_PER_MONTH) -> DataFrame:
    """Dates wanted per calendar month: one rule keeps the day closest to the 15th (earlier on ties), the other the
    first and last date. Months without a rule are dropped. Days of one calendar month are pooled over years only if
    the key does not separate them."""
    rule = F.create_map(*[F.lit(v) for kv in per_month.items() for v in kv])
    rows = dates.select(*key, date).distinct().withColumns({
        "_m": F.month(date), "_k": F.coalesce(F.try_element_at(rule, F.month(date)), F.lit(0)),
    }).filter(F.col("_k") > 0)
    mid = F.min(F.struct(F.abs(F.dayofmonth(date) - 15).alias("gap"), F.col(date).alias("d")))
    picked = rows.groupBy(*key, "_m", "_k").agg(mid.alias("_mid"), F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    chosen = F.when(F.col("_k") == 1, F.array(F.col("_mid.d"))).otherwise(F.array_distinct(F.array("_lo", "_hi")))
    return picked.select(*key, F.explode(chosen).alias(date))


def pick_dates(valid: DataFrame, policy: str, key: Sequence[str] = ("tile",), date: str = "date") -> DataFrame:
    """``latest`` or ``earliest`` usable date per tile, or ``all`` of them."""
    if policy == "all":
        return valid.select(*key, date).distinct()
    if policy not in ("latest", "earliest"):
        raise ValueError(f"policy {policy!r} does not pick dates per tile")
    pick = F.max(date) if policy == "latest" else F.min(date)
    return valid.groupBy(*key).agg(pick.alias(date))


def best_scene_per_day(scenes: DataFrame, key: Sequence[str] = ("date",), cloud: str = "cloud", ident: str = "id") -> DataFrame:
    """Least cloudy scene per day; the smaller id on ties."""
    rest = [c for c in scenes.columns if c not in key and c not in (cloud, ident)]
    best = F.min(F.struct(cloud, ident, *rest))
    return scenes.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def latest_per_key(rows: DataFrame, key: Sequence[str], ident: str, updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """Latest row per key by its update time (creation time when never updated), larger id on ties.

    A max over a struct is partially aggregated before the shuffle, unlike a ranking window.
    """
    rest = [c for c in rows.columns if c not in key]
    best = F.max(F.struct(F.coalesce(updated, created).alias("_ts"), F.col(ident).alias("_id"), F.struct(*rest).alias("_row")))
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, "_b._row.*")


def exact_date_override(planned: DataFrame, overrides: DataFrame, images: DataFrame) -> DataFrame:
    """A recorded date replaces the planned one and skips the quality thresholds.

    ``images`` lists existing (tile, date). A recorded date without an image gives a reason code instead.
    """
    rows = planned.join(overrides.select("tile", F.col("date").alias("_exact")), "tile", "left")
    have = images.select("tile", F.col("date").alias("_exact"), F.lit(True).alias("_has")).distinct()
    rows = rows.join(have, ["tile", "_exact"], "left")
    exact, has = F.col("_exact").isNotNull(), F.coalesce("_has", F.lit(False))
    return rows.withColumns({
        "reason": F.when(exact & ~has, "exact_date_missing_or_invalid").when(
            ~exact & F.col("date").isNull(), F.col("status")),
        "date": F.when(exact, F.when(has, F.col("_exact"))).otherwise(F.col("date")),
        "overridden": exact & has,
    }).drop("_exact", "_has")


def status_report(requested: DataFrame, planned: DataFrame, images: DataFrame) -> DataFrame:
    """Final date and reason code of each requested tile.

    ``planned`` has ``tile, status, date``; ``images`` has ``tile, date, valid`` for the same period. A planned date
    that turns out unusable falls back to the nearest usable one; without any the reason is ``planned_date_not_valid``.
    """
    rows = requested.join(planned.select("tile", "status", F.col("date").alias("planned")), "tile", "left")
    per_date = images.groupBy("tile", "date").agg(F.max(F.coalesce("valid", F.lit(False))).alias("valid"))
    joined = rows.join(per_date, "tile", "left")
    best = F.min(F.when(F.col("valid") & F.col("planned").isNotNull(), _nearest(F.col("date"), F.col("planned"))))
    out = joined.groupBy(*requested.columns, "status", "planned").agg(best.alias("_b"))
    reason = (
        F.when(F.col("status").isNull(), "meta_patch_missing")
        .when(F.col("status") != "valid_tiles", F.col("status"))
        .when(F.col("_b").isNull(), "planned_date_not_valid")
    )
    return out.select(
        *requested.columns, F.when(reason.isNull(), F.col("_b.date")).alias("date"), reason.alias("reason"),
        F.coalesce(F.col("_b.date") != F.col("planned"), F.lit(False)).alias("fell_back"),
    )
