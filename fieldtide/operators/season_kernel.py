"""Detection on whole seasons: gathered once per series, worked through in numpy by Arrow batch.

The rules are those of the column functions in ``functions.series``, step by step in the same order of operations, so
both give the same numbers to the last bit. Seasons of a batch become one matrix with a row per season; a slice of it
never holds more than ``CELLS`` numbers per index, whatever the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from fieldtide import constants as C
from fieldtide.functions.series import savgol_length, savgol_weights

CELLS = 1 << 17


def snap(value: np.ndarray, digits: int = 9) -> np.ndarray:
    scale = float(10**digits)
    return np.rint(value * scale) / scale


def fill(y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Linear interpolation by position over NaN; the ends repeat the nearest value."""
    rows, width = y.shape
    at = np.arange(width)
    known = ~np.isnan(y)
    before = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(known, at, width)[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(rows)[:, None]
    a, b = y[row, np.maximum(before, 0)], y[row, np.minimum(after, width - 1)]
    with np.errstate(all="ignore"):
        drawn = (b - a) / (after - before) * (at - before) + a
    out = np.where(known, y, np.where(before < 0, b, np.where(after >= width, a, drawn)))
    return np.where(at < sizes[:, None], out, np.nan)


def smooth(filled: np.ndarray, sizes: np.ndarray, window: int = C.SAVGOL_WINDOW, poly: int = C.SAVGOL_POLY) -> np.ndarray:
    """Polynomial smoothing: a centred window inside, the end windows' polynomials off centre."""
    out = snap(filled)
    lengths = np.array([savgol_length(k, window, poly) for k in range(window + 1)])[np.minimum(sizes, window)]
    for w in np.unique(lengths):
        if w < 3:
            continue
        here = np.flatnonzero(lengths == w)
        y, n, half = filled[here], sizes[here], w // 2
        weights = np.array(savgol_weights(int(w), poly))
        acc = np.zeros((here.size, y.shape[1] - w + 1))
        for j in range(w):
            acc += y[:, j : j + acc.shape[1]] * weights[half, j]
        new = out[here]
        # Past the last full window these columns are overwritten below or lie beyond the season.
        new[:, half : half + acc.shape[1]] = snap(acc)
        row = np.arange(here.size)
        for ends, shift in ((range(half), np.zeros_like(n)), (range(half + 1, w), n - w)):
            for place in ends:
                value = np.zeros(here.size)
                for j in range(w):
                    value = value + y[row, shift + j] * weights[place, j]
                new[row, shift + place] = snap(value)
        out[here] = np.where(np.arange(y.shape[1]) < n[:, None], new, np.nan)
    return out


def slopes(y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Centred differences with unit spacing, one-sided at the ends."""
    out = np.full_like(y, np.nan)
    if y.shape[1] > 1:
        out[:, 1:-1] = (y[:, 2:] - y[:, :-2]) / 2
        row = np.arange(len(y))
        out[:, 0] = y[:, 1] - y[:, 0]
        last = np.maximum(sizes - 1, 1)
        out[row, last] = y[row, last] - y[row, last - 1]
    return snap(out, 10)


def _first(values: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Position of the first smallest allowed value, and the width where none is allowed."""
    masked = np.where(allowed & ~np.isnan(values), values, np.inf)
    at = masked.argmin(axis=1)
    return np.where(np.isinf(masked[np.arange(len(at)), at]), values.shape[1], at)


def harvest_positions(y: np.ndarray, sizes: np.ndarray, alpha: float = C.PERSIST_ALPHA, k: int = C.PERSIST_K):
    """(start, end, rule) of every season; start and end are -1 unless the peak lies inside."""
    rows, width = y.shape
    at, row = np.arange(width), np.arange(rows)
    slope = slopes(y, sizes)
    peak = _first(-y, np.ones_like(y, bool))[:, None]
    inside = ((peak > 0) & (peak < sizes[:, None] - 1))[:, 0]
    start = _first(slope, at > peak) - 1
    end = _first(y, at >= peak)
    peak = peak[:, 0]
    bound = np.maximum(peak + 1, np.minimum(end, sizes - 1))
    segment = (at > peak[:, None]) & (at < bound[:, None])
    with np.errstate(invalid="ignore"):
        low = segment & (y <= alpha * y[row, np.minimum(peak, width - 1)][:, None])
    run = low.copy()
    for step in range(1, k):
        run[:, : width - step] &= low[:, step:]
        run[:, max(0, width - step) :] = False
    has_run, run_at = run.any(axis=1), run.argmax(axis=1)
    steep = _first(slope, segment)
    retry = (start >= end) & (start != peak)
    clamp = lambda p: np.maximum(peak + 1, np.minimum(p, end - 1))
    no_room = bound - peak - 1 < 1
    chosen = np.where(~retry, start, np.where(no_room, clamp(peak), np.where(has_run, clamp(run_at), clamp(steep))))
    rule = np.where(~retry, "steepest_decline_after_peak", np.where(no_room, "no_derivative_after_peak_retry", np.where(
        has_run, f"threshold_{alpha}_p{k}", "steepest_decline_after_peak_retry"))).astype(object)
    rule[~inside] = "boundary_fallback"
    return np.where(inside, chosen, -1), np.where(inside, end, -1), rule


def rising(y: np.ndarray) -> np.ndarray:
    """Positions at which at least two of the next three steps rise enough, and so does their sum."""
    ahead, width = C.GREENUP_AHEAD, y.shape[1]
    out = np.zeros(y.shape, bool)
    if width > ahead:
        parts = [y[:, s : width - ahead + s] for s in range(ahead + 1)]
        with np.errstate(invalid="ignore"):
            ups = sum((snap(b - a) > C.GREENUP_STEP).astype(int) for a, b in zip(parts, parts[1:]))
            out[:, : width - ahead] = (ups >= C.GREENUP_MIN_STEPS) & (snap(parts[-1] - parts[0]) >= C.GREENUP_TOTAL)
    return out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of seasons whose matrix stays below ``CELLS`` numbers."""
    first, widest = 0, 1
    for k, n in enumerate(sizes.tolist()):
        wider = max(widest, n)
        if k > first and wider * (k - first + 1) > CELLS:
            yield first, k
            first, wider = k, max(1, n)
        widest = wider
    if first < sizes.size:
        yield first, sizes.size


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _kernel(key: Sequence[str], values: Sequence[str], arrays: bool, window: int, poly: int, min_points: int):
    def detect(points: pa.StructArray, sizes: np.ndarray) -> dict[str, pa.Array]:
        rows, width = sizes.size, max(1, int(sizes.max(initial=0)))
        owner = np.repeat(np.arange(rows), sizes)
        days = points.field("_d").cast(pa.int32()).to_numpy(zero_copy_only=False)
        order = np.lexsort((days, owner))
        column = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        day = np.zeros((rows, width), np.int32)
        day[owner, column] = days[order]
        row, starts = np.arange(rows), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        date = lambda v, none=None: pa.array(np.asarray(v, np.int32), pa.int32(), mask=none).cast(pa.date32())
        out = {"n": pa.array(sizes, pa.int32()), "first_date": date(day[:, 0]), "last_date": date(day[row, sizes - 1])}
        if arrays:
            out["dates"] = _lists(starts, date(days[order]))
        for v in values:
            y = np.full((rows, width), np.nan)
            y[owner, column] = points.field(v).to_numpy(zero_copy_only=False)[order]
            valid = (~np.isnan(y)).sum(axis=1)
            usable = (sizes >= 3) & (valid >= min_points)
            y = smooth(fill(y, sizes), sizes, window, poly)
            y[~usable] = np.nan
            start, end, rule = harvest_positions(y, sizes)
            rule[~usable] = "insufficient_data"
            found = usable & (start >= 0)
            pick = lambda p: date(day[row, np.where(found, p, 0)], ~found)
            marks = rising(y)
            marked = np.concatenate([[0], np.cumsum(marks.sum(axis=1))])
            out |= {f"{v}_valid": pa.array(valid, pa.int32()), f"{v}_start": pick(start), f"{v}_end": pick(end),
                    f"{v}_rule": pa.array(rule, pa.string()), f"{v}_rising": _lists(marked, date(day[marks]))}
            if arrays:
                kept = np.repeat(usable, sizes)
                smoothed = pa.array(y[owner, column][kept], pa.float64())
                sized = np.where(usable, sizes, 0)
                lists = _lists(np.concatenate([[0], np.cumsum(sized)]), smoothed)
                out[f"{v}_smooth"] = pc.if_else(pa.array(usable), lists, pa.scalar(None, lists.type))
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("_p")
            ends = points.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            inner = points.values
            for a, b in _slices(sizes):
                found = detect(inner.slice(ends[a], ends[b] - ends[a]), sizes[a:b])
                yield pa.RecordBatch.from_pydict({**{k: batch.column(k).slice(a, b - a) for k in key}, **found})

    return kernel


def detected_seasons(
    obs: DataFrame, key: Sequence[str], values: Sequence[str], date: str = "date", window: int = C.SAVGOL_WINDOW,
    poly: int = C.SAVGOL_POLY, min_points: int = C.MIN_POINTS, arrays: bool = False, daily: bool = False,
) -> DataFrame:
    """One row per key: n, first_date, last_date, and per value ``v`` its v_valid (known points), v_start, v_end (null when
    not detected), v_rule and v_rising (dates at which green-up may begin, ascending); with ``arrays`` also dates and
    v_smooth (null with too few points).

    Several readings of a day are averaged first, by a partial aggregate, so that a group holds at most the days of a
    season. ``daily`` says that there is one row per key and date already, and saves that exchange. NaN counts as missing.
    """
    if not daily:
        obs = obs.groupBy(*key, date).agg(*[F.avg(v).alias(v) for v in values])
    point = F.struct(F.col(date).alias("_d"), *[F.col(v).cast("double").alias(v) for v in values])
    gathered = obs.groupBy(*key).agg(F.collect_list(point).alias("_p"))
    days = T.ArrayType(T.DateType())
    schema = T.StructType([f for f in gathered.schema.fields if f.name != "_p"])
    schema = schema.add("n", T.IntegerType()).add("first_date", T.DateType()).add("last_date", T.DateType())
    if arrays:
        schema = schema.add("dates", days)
    for v in values:
        schema = schema.add(f"{v}_valid", T.IntegerType()).add(f"{v}_start", T.DateType()).add(f"{v}_end", T.DateType())
        schema = schema.add(f"{v}_rule", T.StringType()).add(f"{v}_rising", days)
        if arrays:
            schema = schema.add(f"{v}_smooth", T.ArrayType(T.DoubleType()))
    names = [f.name for f in schema.fields]
    kernel = _kernel(list(key), list(values), arrays, window, poly, min_points)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel(batches):
            yield batch.select(names)

    return gathered.mapInArrow(ordered, schema)
