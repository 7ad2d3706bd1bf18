"""Calendar projections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldtide import constants as C


def parse_date(text: Column) -> Column:
    """Strict ``yyyy-MM-dd``; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), trimmed.try_cast("date"))


def doy(date_or_text: Column, is_text: bool = False) -> Column:
    return F.dayofyear(parse_date(date_or_text) if is_text else date_or_text)


def year_length(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def doy_to_date(year: Column, day: Column) -> Column:
    """Clamp to the year's length, then 1 January plus ``day - 1``."""
    safe = F.greatest(F.least(day, year_length(year)), F.lit(1))
    return F.when(day.isNotNull(), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (safe - 1).cast("int")))


def doy_bin(day: Column) -> Column:
    return F.least(F.floor((day - 1) / F.lit(C.BIN_DAYS)), F.lit(C.NUM_BINS - 1)).cast("int")


def month_day_number(text: Column) -> Column:
    """``MM-DD`` to ``month * 100 + day``."""
    return F.substring(text, 1, 2).cast("int") * 100 + F.substring(text, 4, 2).cast("int")


def in_month_day_window(date: Column, start_md: Column, end_md: Column) -> Column:
    """Inclusive; a window whose start is after its end wraps around the new year."""
    now = F.month(date) * 100 + F.dayofmonth(date)
    start, end = month_day_number(start_md), month_day_number(end_md)
    return F.when(start <= end, now.between(start, end)).otherwise((now >= start) | (now <= end))


def month_day_in_year(year: Column, md: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), md).try_cast("date")


def decode_doy(start01: Column, end01: Column) -> Column:
    """Two scaled outputs to (start, end) days of the year, end never before start."""
    def one(v: Column) -> Column:
        return F.when(v.isNotNull(), F.greatest(F.least(F.rint(v * 366), F.lit(366.0)), F.lit(1.0))).cast("int")

    start, end = one(start01), one(end01)
    return F.struct(start.alias("start_doy"), F.greatest(start, end).alias("end_doy"))


def encode_doy(day: Column) -> Column:
    return F.coalesce(day / F.lit(366.0), F.lit(0.0))


def clamp_model_month(month: Column) -> Column:
    return F.greatest(F.least(month, F.lit(C.MODEL_MONTH_MAX)), F.lit(C.MODEL_MONTH_MIN))


def choose_model_month(explicit: Column, month: Column, latest_available: Column) -> Column:
    clamped = F.when(month.isNotNull(), clamp_model_month(month))
    return F.coalesce(explicit, clamped, latest_available)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_range(year: Column, month: Column) -> Column:
    first = month_start(year, month)
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def previous_month(date: Column) -> Column:
    first = F.add_months(F.trunc(date, "MM"), -1)
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def max_doy_for_month(year: Column, month: Column) -> Column:
    return F.dayofyear(F.last_day(month_start(year, month)))


def month_tag(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year, month)


def pseudo_month_date(year: Column, month: Column, day: Column) -> Column:
    length = F.dayofmonth(F.last_day(month_start(year, month)))
    return F.make_date(year, month, F.greatest(F.least(day, length), F.lit(1)))


def split_by_month(start: Column, end: Column) -> Column:
    """Array of (part_start, part_end), one per calendar month, clipped to the period.

    A period that ends before it starts is an error.
    """
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    pieces = F.transform(
        months,
        lambda m: F.struct(
            F.greatest(m.cast("date"), start).alias("part_start"),
            F.least(F.last_day(m), end).alias("part_end"),
        ),
    )
    return F.when(end < start, F.raise_error(F.lit("period ends before it starts"))).otherwise(pieces)


def harvest_iou(start: Column, end: Column, window_start: Column, window_end: Column, gt_year: Column) -> Column:
    """Overlap of the predicted period with the target window in ``gt_year``, in days.

    Pass ``lit(2019)`` as the year to use one fixed target year for every record.
    """
    ws, we = month_day_in_year(gt_year, window_start), month_day_in_year(gt_year, window_end)
    known = start.isNotNull() & end.isNotNull() & ws.isNotNull() & we.isNotNull()
    inter = F.greatest(F.datediff(F.least(end, we), F.greatest(start, ws)), F.lit(0))
    union = F.datediff(F.greatest(end, we), F.least(start, ws))
    return F.when(known, F.try_divide(inter.cast("double"), union.cast("double")))


def date_from_output_name(path: Column) -> Column:
    """Trailing ``_YYYYMMDD`` of a file name, or null."""
    digits = F.regexp_extract(path, r"_(\d{8})\.[A-Za-z0-9]+$", 1)
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))
