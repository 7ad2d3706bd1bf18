"""The series rules on arrays: one array holds one season, at most one value per calendar day.

Where a whole season is reduced to a few dates, working on the array inside the row avoids a chain of window passes:
the season is gathered once, and everything after is a projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from fieldtide import constants as C


def snap(value: Column, digits: int = 9) -> Column:
    """Round to ``digits`` decimals in binary arithmetic, so last-bit noise cannot move an extreme."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def savgol_weights(window: int, poly: int) -> tuple[tuple[float, ...], ...]:
    """Row ``e`` holds the weights that evaluate the window's least-squares polynomial at position ``e``."""
    poly = min(poly, window - 1)
    x = np.arange(window, dtype=float) - (window - 1) / 2
    a = np.vander(x, poly + 1, increasing=True)
    return tuple(tuple(float(v) for v in row) for row in a @ np.linalg.pinv(a))


def savgol_length(n: int, window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY) -> int:
    """Window length used for a series of ``n`` points; below 3 the series is copied."""
    odd_down = lambda v: v if v % 2 else v - 1
    w = odd_down(min(window, n))
    if w <= poly:
        w = poly + 2 if (poly + 2) % 2 else poly + 3
    return odd_down(n) if w > n else w


def window_length(n: Column, window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY) -> Column:
    per_n = ", ".join(str(savgol_length(k, window, poly)) for k in range(window + 1))
    return F.get(F.expr(f"array({per_n})"), F.least(n, F.lit(window)).cast("int"))


def window_lengths(window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY) -> list[int]:
    return sorted({w for n in range(window + 1) if (w := savgol_length(n, window, poly)) >= 3})


def matrix_constant(length: int, poly: int = C.SAVGOL_POLY) -> Column:
    """The weight matrix of one window length as a constant, parsed from text in one step."""
    rows = ", ".join("array(" + ", ".join(f"{v!r}D" for v in r) + ")" for r in savgol_weights(length, poly))
    return F.expr(f"array({rows})")


def weight_matrix(length: Column, window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY) -> Column:
    """The weight matrix of a window length; a constant of the plan."""
    out = None
    for w in window_lengths(window, poly):
        matrix = matrix_constant(w, poly)
        out = F.when(length == w, matrix) if out is None else out.when(length == w, matrix)
    return out


def fill(y: Column) -> Column:
    """Linear interpolation by position over nulls; the ends repeat the nearest value. Null when nothing is known."""
    n = F.size(y)
    points = F.filter(
        F.transform(y, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"].isNotNull()
    )
    nothing = F.lit(None).cast("struct<i:int,v:double>")
    pairs = F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, n), F.array(nothing)).alias("b"))
    drawn = F.flatten(F.transform(
        pairs,
        lambda p: F.when(p["b"].isNull(), F.array(p["a"]["v"])).otherwise(F.transform(
            F.sequence(p["a"]["i"], p["b"]["i"] - 1),
            lambda i: F.when(i == p["a"]["i"], p["a"]["v"]).otherwise(
                (p["b"]["v"] - p["a"]["v"]) / (p["b"]["i"] - p["a"]["i"]) * (i - p["a"]["i"]) + p["a"]["v"]
            ),
        )),
    ))
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    whole = F.concat(F.array_repeat(first["v"], first["i"]), drawn, F.array_repeat(last["v"], n - 1 - last["i"]))
    return F.when(~F.exists(y, lambda v: v.isNull()), y).when(first.isNotNull(), whole)


def smooth(filled: Column, matrix: Column, length: Column) -> Column:
    """Polynomial smoothing: a centred window inside, the end windows' polynomials off centre."""
    n = F.size(filled)
    half = F.floor(length / 2).cast("int")

    def at(v: Column, i: Column) -> Column:
        start = F.greatest(F.least(i - half, n - length), F.lit(0))
        products = F.zip_with(F.slice(filled, start + 1, length), F.get(matrix, i - start), lambda a, w: a * w)
        return snap(F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p))

    return F.when(length < 3, F.transform(filled, lambda v: snap(v))).otherwise(F.transform(filled, at))


def slopes(values: Column) -> Column:
    """Centred differences with unit spacing, one-sided at the ends."""
    n = F.size(values)

    def at(v: Column, i: Column) -> Column:
        before, after = F.get(values, i - 1), F.get(values, i + 1)
        return snap(
            F.when((i > 0) & (i < n - 1), (after - before) / 2).when(i == 0, after - v).otherwise(v - before), 10
        )

    return F.transform(values, at)


def first_minimum(values: Column) -> Column:
    """Zero-based position of the first minimum."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def first_maximum(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def harvest_positions(values: Column, slope: Column, peak: Column, alpha: float = C.PERSIST_ALPHA, k: int = C.PERSIST_K) -> Column:
    """Start and end positions and the start rule of a smoothed season whose peak is inside.

    First choice: one position before the steepest fall after the peak, and the first minimum from the peak on. When
    that start is not before the end, a run of ``k`` values at or below ``alpha`` times the peak decides, then the
    steepest fall inside the right bound; the result is clamped between peak and end.
    """
    n = F.size(values)
    start = peak + first_minimum(F.slice(slope, peak + 2, n))
    end = peak + first_minimum(F.slice(values, peak + 1, n))
    bound = F.greatest(peak + 1, F.least(end, n - 1))
    room = bound - peak - 1
    segment = F.slice(values, peak + 2, room)
    limit = F.lit(alpha) * F.get(values, peak)
    low = lambda i: F.coalesce(F.get(segment, i) <= limit, F.lit(False))

    def runs(v: Column, i: Column) -> Column:
        ok = low(i)
        for step in range(1, k):
            ok = ok & low(i + step)
        return ok

    run = F.array_position(F.transform(segment, runs), F.lit(True)).cast("int")
    steep = first_minimum(F.slice(slope, peak + 2, room))
    retry = (start >= end) & (start != peak)
    clamp = lambda p: F.greatest(peak + 1, F.least(p, end - 1))
    return F.when(~retry, F.struct(
        start.alias("start_i"), end.alias("end_i"), F.lit("steepest_decline_after_peak").alias("rule")
    )).when(room < 1, F.struct(
        clamp(peak).alias("start_i"), end.alias("end_i"), F.lit("no_derivative_after_peak_retry").alias("rule")
    )).when(run > 0, F.struct(
        clamp(peak + run).alias("start_i"), end.alias("end_i"), F.lit(f"threshold_{alpha}_p{k}").alias("rule")
    )).otherwise(F.struct(
        clamp(peak + 1 + steep).alias("start_i"), end.alias("end_i"), F.lit("steepest_decline_after_peak_retry").alias("rule")
    ))


def rising_dates(dates: Column, values: Column, inside) -> Column:
    """Dates passing ``inside`` at which at least two of the next three steps rise enough, and so does their sum."""
    ahead, n = C.GREENUP_AHEAD, F.size(values)

    def ok(i: Column) -> Column:
        y = [F.get(values, i + s) for s in range(ahead + 1)]
        ups = sum((F.when(snap(b - a) > C.GREENUP_STEP, 1).otherwise(0) for a, b in zip(y, y[1:])), F.lit(0))
        return inside(F.get(dates, i)) & (ups >= C.GREENUP_MIN_STEPS) & (snap(y[-1] - y[0]) >= C.GREENUP_TOTAL)

    spots = F.when(n > ahead, F.sequence(F.lit(0), n - 1 - ahead)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(spots, ok), lambda i: F.get(dates, i))
