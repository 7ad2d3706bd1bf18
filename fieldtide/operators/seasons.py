"""Series operators: gap filling, smoothing, and detection of harvest and green-up dates.

A series is all rows of one key, one row per date. Everything works on the position of a date in its series, not on
elapsed days. A series holds at most one row per calendar day (``unique_dates`` enforces it with a map-side partial
aggregate), so a window partition is bounded by the days of a season, however skewed the raw pixels were.

The row operators share one window partitioning, so a chain of them costs one shuffle. Operators that reduce a season
to dates gather it once and run the same rules in ``season_kernel``.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide import constants as C
from fieldtide.functions import series as A
from fieldtide.functions.dates import month_day_number
from fieldtide.functions.series import snap, window_length, window_lengths
from fieldtide.operators.season_kernel import detected_seasons

ROUND = 9  # positions of extremes are picked on values rounded here, so last-bit noise cannot move them
PART_ROWS = 1 << 17  # rows of whole series that a task holds at a time


def by_series(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` hashed by ``key`` into parts of about ``PART_ROWS`` rows.

    Their number follows the rows, so what a task sorts or gathers does not grow with the table. Windows and groupings
    whose keys include ``key`` need no further exchange. The count of a scanned table is read off its footers.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() // PART_ROWS)), *key)


def unique_dates(obs: DataFrame, key: Sequence[str], values: Sequence[str], date: str = "date") -> DataFrame:
    """One row per key and date; several readings of a day are averaged."""
    return obs.groupBy(*key, date).agg(*[F.avg(v).alias(v) for v in values])


def long_indices(
    obs: DataFrame, key: Sequence[str], indices: Sequence[str], date: str = "date", partition: bool = True
) -> DataFrame:
    """One row per key, date and index name.

    The rows are hashed by the series key first: each later window over (key, index_name) and the final
    regrouping by key then need no further exchange, and the shuffle carries the wide rows only once.
    """
    rows = obs.select(*key, date, *indices)
    if partition:
        rows = rows.repartition(*[F.col(k) for k in key])
    named = F.array(*[F.struct(F.lit(n.upper()).alias("index_name"), F.col(n).alias("y")) for n in indices])
    return rows.select(*key, date, F.inline(named))


def positions(series: DataFrame, key: Sequence[str], y: str = "y", date: str = "date") -> DataFrame:
    """Adds ``i`` (zero-based position), ``n`` (length) and ``n_valid``."""
    whole = W.partitionBy(*key)
    return series.select(
        "*",
        (F.row_number().over(whole.orderBy(date)) - 1).alias("i"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n"),
        F.count(y).over(whole).cast("int").alias("n_valid"),
    )


def fill_gaps(
    series: DataFrame, key: Sequence[str], y: str = "y", date: str = "date", out: str = "filled"
) -> DataFrame:
    """Linear interpolation by position; the ends repeat the nearest value. Adds ``i``, ``n``, ``n_valid``, ``out``."""
    rows = positions(series, key, y, date)
    point = F.when(F.col(y).isNotNull(), F.struct(F.col("i").alias("i"), F.col(y).alias("y")))
    # The following valid point is read backwards: a growing frame stays linear, a shrinking one would not.
    back = W.partitionBy(*key).orderBy(F.col(date).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*key).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_next", F.last(point, ignorenulls=True).over(back))
    rows = rows.withColumn("_prev", F.last(point, ignorenulls=True).over(ahead))
    px, py, nx, ny = F.col("_prev.i"), F.col("_prev.y"), F.col("_next.i"), F.col("_next.y")
    slope = (ny - py) / (nx - px)
    value = (
        F.when(F.col(y).isNotNull(), F.col(y))
        .when(px.isNull(), ny)
        .when(nx.isNull(), py)
        .otherwise(slope * (F.col("i") - px) + py)
    )
    return rows.withColumn(out, value).drop("_prev", "_next")


def savgol(
    series: DataFrame, key: Sequence[str], y: str = "filled", date: str = "date", out: str = "smooth",
    window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY,
) -> DataFrame:
    """Polynomial smoothing of a gap-free series carrying ``i`` and ``n``.

    Inside, a centred window; near an end, the polynomial of the first or last full window off its centre.
    The weights are a constant of the plan (one small matrix per window length), so nothing is joined.
    """
    lengths = window_lengths(window, poly)
    used = window_length(F.col("n"), window, poly)
    reach = max(lengths) - 1
    near = W.partitionBy(*key).orderBy(date).rowsBetween(-reach, reach)
    rows = series.withColumn("_near", F.collect_list(y).over(near)).withColumn("_w", used)

    half = F.floor(F.col("_w") / 2).cast("int")
    start = F.greatest(F.least(F.col("i") - half, F.col("n") - F.col("_w")), F.lit(0))
    offset = start - F.greatest(F.col("i") - reach, F.lit(0))
    weights = F.get(A.weight_matrix(F.col("_w"), window, poly), (F.col("i") - start).cast("int"))
    rows = rows.withColumn("_weights", weights).withColumn("_part", F.slice(F.col("_near"), (offset + 1).cast("int"), F.col("_w")))
    dot = F.aggregate(
        F.zip_with("_weights", "_part", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )
    value = F.when(F.col("_w") < 3, F.col(y)).otherwise(dot)
    return rows.withColumn(out, snap(value, ROUND)).drop("_near", "_w", "_weights", "_part")


def gradient(
    series: DataFrame, key: Sequence[str], y: str = "smooth", date: str = "date", out: str = "slope"
) -> DataFrame:
    """Centred difference with unit spacing, one-sided at the ends; null for a series of one point."""
    w = W.partitionBy(*key).orderBy(date)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    value = F.coalesce((after - before) / 2, after - F.col(y), F.col(y) - before)
    # Halving a nine-decimal difference gives ten decimals at most.
    return series.withColumn(out, snap(value, ROUND + 1))


def _first_min(value: Column, condition: Column) -> Column:
    """Smallest value where the condition holds, first position on ties. Nulls never compete."""
    return F.min(F.when(condition & value.isNotNull(), F.struct(value.alias("v"), F.col("i").alias("i"))))


def find_peak(series: DataFrame, key: Sequence[str], y: str = "smooth") -> DataFrame:
    """Adds ``peak_i``, ``peak_y`` (first maximum) and ``boundary`` when it sits at either end."""
    whole = W.partitionBy(*key)
    rows = series.withColumn("_p", _first_min(-F.col(y), F.lit(True)).over(whole))
    return rows.select(
        *series.columns,
        F.col("_p.i").alias("peak_i"), (-F.col("_p.v")).alias("peak_y"),
        ((F.col("_p.i") <= 0) | (F.col("_p.i") >= F.col("n") - 1)).alias("boundary"),
    )


def decline_and_minimum(series: DataFrame, key: Sequence[str], y: str = "smooth", slope: str = "slope") -> DataFrame:
    """Adds ``start_i`` (one position before the steepest fall after the peak) and ``end_i`` (first minimum from it on)."""
    whole = W.partitionBy(*key)
    i, peak = F.col("i"), F.col("peak_i")
    rows = series.withColumn("_s", _first_min(F.col(slope), i > peak).over(whole)).withColumn(
        "_e", _first_min(F.col(y), i >= peak).over(whole)
    )
    return rows.select(
        *series.columns,
        F.coalesce(F.col("_s.i") - 1, peak).alias("start_i"), F.col("_e.i").alias("end_i"),
    )


def persistent_below(
    series: DataFrame, key: Sequence[str], y: str = "smooth", slope: str = "slope", date: str = "date",
    alpha: float = C.PERSIST_ALPHA, k: int = C.PERSIST_K,
) -> DataFrame:
    """Second choice of the start for series whose first choice is not before the end.

    Adds ``retry`` (whether it applies), ``run_i`` (first of ``k`` values at or below ``alpha`` times the peak, all
    between the peak and the right bound) and ``steep_i`` (steepest fall in that range).
    """
    ordered, whole = W.partitionBy(*key).orderBy(date), W.partitionBy(*key)
    i, peak, start, end = (F.col(c) for c in ("i", "peak_i", "start_i", "end_i"))
    retry = (~F.col("boundary")) & (start >= end) & (start != peak)
    bound = F.greatest(peak + 1, F.least(end, F.col("n") - 1))
    below = (F.col(y) <= F.lit(alpha) * F.col("peak_y")).cast("int")
    rows = series.withColumn("_below", below)
    # Length of the run starting here, looked at k positions ahead only.
    run = F.col("_below")
    for step in range(1, k):
        run = run + F.coalesce(F.lead("_below", step).over(ordered), F.lit(0))
    rows = rows.withColumn("_run", run).withColumn("retry", retry)
    inside = F.col("retry") & (i >= peak + 1)
    return rows.select(
        *series.columns, "retry",
        F.min(F.when(inside & (i + k - 1 < bound) & (F.col("_run") >= k), i)).over(whole).alias("run_i"),
        _first_min(F.col(slope), inside & (i < bound)).over(whole)["i"].alias("steep_i"),
    )


def detect_rows(
    series: DataFrame, key: Sequence[str], y: str = "y", date: str = "date",
    window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY,
) -> DataFrame:
    """Every position with its filled, smoothed and derived values and the series' chosen positions."""
    rows = fill_gaps(series, key, y, date)
    rows = savgol(rows, key, "filled", date, window=window, poly=poly)
    rows = gradient(rows, key, "smooth", date)
    rows = find_peak(rows, key)
    rows = decline_and_minimum(rows, key)
    return persistent_below(rows, key, date=date)


def season_arrays(
    obs: DataFrame, key: Sequence[str], values: Sequence[str], date: str = "date", window: int = C.SAVGOL_WINDOW,
    poly: int = C.SAVGOL_POLY, min_points: int = C.MIN_POINTS,
) -> DataFrame:
    """One row per key: ``dates``, ``n``, and per value column ``v`` its ``v_valid`` and ``v_smooth`` (null when there are
    too few points)."""
    rows = detected_seasons(obs, key, values, date, window, poly, min_points, arrays=True)
    return rows.select(*key, "dates", "n", *[f"{v}_valid" for v in values], *[f"{v}_smooth" for v in values])


def detect_harvest(
    series: DataFrame, key: Sequence[str], y: str = "y", date: str = "date", min_points: int = C.MIN_POINTS,
    window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY, daily: bool = False,
) -> DataFrame:
    """One row per series: ``start``, ``end`` (null when not detected), ``start_rule`` and counts. With ``daily`` a series
    has one row per date already."""
    rows = detected_seasons(series, key, [y], date, window, poly, min_points, daily=daily)
    return rows.select(
        *key, F.col(f"{y}_start").alias("start"), F.col(f"{y}_end").alias("end"), F.col(f"{y}_rule").alias("start_rule"),
        "n", F.col(f"{y}_valid").alias("n_valid"), "first_date", "last_date",
    )


def greenup_marks(series: DataFrame, key: Sequence[str], y: str = "smooth", date: str = "date") -> DataFrame:
    """Adds ``rising``: at least two of the next three steps rise enough, and so does their sum.

    A position with fewer than three values ahead is never rising.
    """
    w = W.partitionBy(*key).orderBy(date)
    ahead = [F.col(y)] + [F.lead(y, s).over(w) for s in range(1, C.GREENUP_AHEAD + 1)]
    ups = sum(
        (F.when(snap(b - a, ROUND) > C.GREENUP_STEP, 1).otherwise(0) for a, b in zip(ahead, ahead[1:])), F.lit(0)
    )
    total = snap(ahead[-1] - ahead[0], ROUND)
    ok = ahead[-1].isNotNull() & (ups >= C.GREENUP_MIN_STEPS) & (total >= C.GREENUP_TOTAL)
    return series.withColumn("rising", F.coalesce(ok, F.lit(False)))


def find_greenup(
    series: DataFrame, key: Sequence[str], window_start: str, window_end: str, y: str = "smooth", date: str = "date"
) -> DataFrame:
    """First rising date inside the window columns (dates), one row per key; null when there is none."""
    rows = greenup_marks(series, key, y, date)
    inside = F.col(date).between(F.col(window_start), F.col(window_end))
    return rows.groupBy(*key).agg(F.min(F.when(F.col("rising") & inside, F.col(date))).alias("greenup"))


def seeding_from_greenup(ndvi_greenup: Column, evi_greenup: Column, offset: Column, year: Column) -> Column:
    """NDVI first, EVI as the second choice; the sowing date counts only inside the same year."""
    greenup = F.coalesce(ndvi_greenup, evi_greenup)
    back = F.date_sub(greenup, offset.cast("int"))
    source = F.when(ndvi_greenup.isNotNull(), "NDVI").when(evi_greenup.isNotNull(), "EVI").otherwise("")
    return F.struct(
        greenup.alias("greenup"), F.when(F.year(back) == year, back).alias("seeding"),
        source.alias("source"), F.when(greenup.isNotNull(), C.GREENUP_RULE).otherwise("").alias("rule"),
    )


def sowing_window(settings: DataFrame) -> DataFrame:
    """The settings dimension with its window as month-day numbers ``_ws`` and ``_we``."""
    return settings.withColumns({"_ws": month_day_number(F.col("window_start")), "_we": month_day_number(F.col("window_end"))})


def first_greenup(rising: Column, first_date: Column) -> Column:
    """First of the rising dates inside the sowing window, which lies in the year of the first date."""
    year = F.year(first_date)
    inside = lambda d: (F.year(d) == year) & (F.month(d) * 100 + F.dayofmonth(d)).between(F.col("_ws"), F.col("_we"))
    return F.when(F.col("_ws").isNotNull(), F.array_min(F.filter(rising, inside)))


def estimate_seeding(
    obs: DataFrame, key: Sequence[str], seeding: DataFrame, crop: str = "crop", date: str = "date",
    min_points: int = C.MIN_POINTS, window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY, daily: bool = False,
) -> DataFrame:
    """One row per series: green-up, sowing date, source index, rule and the settings used.

    ``seeding`` is the settings dimension (one row per crop). Crops without a window keep blank results.
    """
    rows = detected_seasons(obs, key, ("ndvi", "evi"), date, window, poly, min_points, daily=daily)
    rows = rows.join(sowing_window(seeding), crop, "left")
    found = seeding_from_greenup(*(first_greenup(F.col(f"{v}_rising"), F.col("first_date")) for v in ("ndvi", "evi")),
                                 F.col("offset_days"), F.year("first_date"))
    return rows.withColumn("_f", found).select(
        *key, F.col("_f.greenup").alias("greenup"), F.col("_f.seeding").alias("seeding"),
        F.col("_f.source").alias("greenup_source"), F.col("_f.rule").alias("greenup_rule"),
        "offset_days", "window_start", "window_end",
    )


def min_points(series: DataFrame, key: Sequence[str], n: int, y: str = "y") -> DataFrame:
    """Keep series with at least ``n`` usable points."""
    counted = series.withColumn("_c", F.count(y).over(W.partitionBy(*key)))
    return counted.filter(F.col("_c") >= n).drop("_c")
