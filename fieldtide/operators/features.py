"""Five-day feature tensors and labels built from season rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide import constants as C
from fieldtide.functions.dates import doy_bin, in_month_day_window, parse_date
from fieldtide.functions.text import to_double_lenient


def feature_names(feature_set: str) -> tuple[str, ...]:
    if feature_set not in C.FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; expected one of {sorted(C.FEATURE_SETS)}")
    return C.FEATURE_SETS[feature_set]


def labels_from_rows(
    rows: DataFrame, key: Sequence[str], flag: str = "harvest", day: str = "doy", order: str = "row_no"
) -> DataFrame:
    """Start and end day per key from the flagged rows; the last flag in row order wins."""
    pick = lambda text: F.max_by(
        F.when(F.col(flag) == text, F.col(day)), F.when(F.col(flag) == text, F.col(order))
    )
    return rows.groupBy(*key).agg(pick("Start").alias("start_doy"), pick("End").alias("end_doy"))


def require_labels(records: DataFrame, start: str = "start_doy", end: str = "end_doy") -> DataFrame:
    return records.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))


def bin_features(
    obs: DataFrame, key: Sequence[str], features: Sequence[str], day: str = "doy"
) -> DataFrame:
    """Mean of each feature's present values per key and five-day bin, plus the share of features present."""
    means = [F.avg(f).alias(f) for f in features]
    binned = obs.groupBy(*key, doy_bin(F.col(day)).alias("bin")).agg(*means)
    present = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    return binned.withColumn("valid_fraction", present / F.lit(float(len(features))))


def interpolate_inside(
    bins: DataFrame, key: Sequence[str], value: str = "value", bin_col: str = "bin", n_bins: int = C.NUM_BINS
) -> DataFrame:
    """Dense bins per key: linear between the first and last observed bin, 0 outside.

    Each observed bin emits itself and the gap up to the next observed one, so no dense grid is joined. Values are
    held in single precision as stored tensors are; the line itself is computed in double precision.
    """
    w = W.partitionBy(*key).orderBy("_b")
    rows = bins.filter(F.col(value).isNotNull()).select(
        *key, F.col(bin_col).alias("_b"), F.col(value).cast("float").cast("double").alias("_v")
    )
    rows = rows.select(
        "*", F.lead("_b").over(w).alias("_nb"), F.lead("_v").over(w).alias("_nv"),
        F.lag("_b").over(w).isNull().alias("_first"),
    )
    slope = (F.col("_nv") - F.col("_v")) / (F.col("_nb") - F.col("_b"))
    start = F.when(F.col("_first"), 0).otherwise(F.col("_b"))
    stop = F.coalesce(F.col("_nb") - 1, F.lit(n_bins - 1))
    rows = rows.withColumn("_slope", slope).withColumn(bin_col, F.explode(F.sequence(start, stop)))
    b = F.col(bin_col)
    out = (
        F.when(b < F.col("_b"), 0.0).when(b == F.col("_b"), F.col("_v"))
        .when(F.col("_nb").isNull(), 0.0)
        .otherwise(F.col("_slope") * (b - F.col("_b")) + F.col("_v"))
    )
    return rows.select(*key, bin_col, out.cast("float").alias(value))


def assemble_tensor(
    binned: DataFrame, key: Sequence[str], features: Sequence[str], n_bins: int = C.NUM_BINS
) -> DataFrame:
    """One row per key with ``x``: an array of ``features + 1`` channels of ``n_bins`` floats.

    The binned rows of a key (at most ``n_bins``) are gathered once; every channel is drawn inside that row.
    """
    rows = binned.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("bin", *features, "valid_fraction"))).alias("_bins")
    )
    return rows.select(*key, tensor(F.col("_bins"), features, n_bins).alias("x"))


def tensor(bins: Column, features: Sequence[str], n_bins: int = C.NUM_BINS) -> Column:
    """Interpolated channels, then the share of features present, from one key's sorted array of bin structs."""
    channels = [lay_out(bins, f, n_bins) for f in features]
    return F.array(*channels, lay_out(bins, "valid_fraction", n_bins, between=False))


def lay_out(bins: Column, field: str, n_bins: int = C.NUM_BINS, between: bool = True) -> Column:
    """One channel of ``n_bins`` floats: observed bins hold their value, gaps between them the straight line (or zero),
    everything outside zero. The same rule as :func:`interpolate_inside`, on an array."""
    zero = F.lit(0.0).cast("float")
    zeros = lambda n: F.array_repeat(zero, n)
    seen = F.transform(
        F.filter(bins, lambda b: b[field].isNotNull()),
        lambda b: F.struct(b["bin"].alias("bin"), b[field].cast("float").cast("double").alias("value")),
    )
    nothing = F.lit(None).cast("struct<bin:int,value:double>")
    pairs = F.arrays_zip(seen.alias("a"), F.concat(F.slice(seen, 2, n_bins), F.array(nothing)).alias("b"))

    def stretch(p: Column) -> Column:
        here, after = p["a"], p["b"]
        slope = (after["value"] - here["value"]) / (after["bin"] - here["bin"])
        first = F.array(here["value"].cast("float"))
        line = F.transform(
            F.sequence(here["bin"] + 1, after["bin"] - 1),
            lambda t: (slope * (t - here["bin"]) + here["value"]).cast("float"),
        )
        gap = line if between else zeros(after["bin"] - here["bin"] - 1)
        return F.when(after.isNull() | (after["bin"] == here["bin"] + 1), first).otherwise(F.concat(first, gap))

    # Without any value the one pair is empty and draws nothing.
    drawn = F.flatten(F.transform(F.filter(pairs, lambda p: p["a"].isNotNull()), stretch))
    before = F.coalesce(F.try_element_at(seen, F.lit(1))["bin"], F.lit(n_bins))
    after = n_bins - 1 - F.coalesce(F.try_element_at(seen, F.lit(-1))["bin"], F.lit(n_bins - 1))
    return F.concat(zeros(before), drawn, zeros(after))


def build_records(
    rows: DataFrame, feature_set: str = "all_indices", windows: DataFrame | None = None,
    crops: Sequence[str] | None = None, years: Sequence[int] | None = None, min_points: int = 2,
    labelled_only: bool = True, round4: bool = False, key: Sequence[str] = ("year", "tile", "crop"),
) -> DataFrame:
    """Season rows (``date`` as text or date, ``ndvi``.., ``harvest`` flag, ``row_no``) to feature records.

    Observations outside a crop's month-day window are left out, labels there still count. ``round4`` uses values as
    stored in summary files, with four decimals.
    """
    names = [f.lower() for f in feature_names(feature_set)]
    types = dict(rows.dtypes)
    if crops is not None:
        rows = rows.filter(F.col("crop").isin(*crops))
    if years is not None:
        rows = rows.filter(F.col("year").isin(*years))
    rows = rows.filter(F.trim("crop") != "")
    date = parse_date(F.col("date")) if types["date"] == "string" else F.col("date")
    values = [
        (to_double_lenient(F.col(f)) if types[f] == "string" else F.col(f)).alias(f) for f in names
    ]
    rows = rows.select(*key, date.alias("date"), "harvest", "row_no", *values).filter(F.col("date").isNotNull())
    if round4:
        rows = rows.withColumns({f: F.round(f, 4) for f in names})
    rows = rows.withColumn("doy", F.dayofyear("date"))
    kept = F.lit(True)
    if windows is not None:
        rows = rows.join(windows.select("crop", "start_md", "end_md"), "crop", "left")
        kept = F.coalesce(in_month_day_window(F.col("date"), F.col("start_md"), F.col("end_md")), F.lit(True))
    observed = kept & F.coalesce(*[F.col(f) for f in names]).isNotNull()
    rows = rows.withColumn("_obs", observed)

    # Labels and counts per bin first: the groups that travel hold at most 73 bins, never raw rows.
    flag_day = lambda text: F.max(F.when(F.trim("harvest") == text, F.struct("row_no", "doy")))
    binned = rows.groupBy(*key, doy_bin(F.col("doy")).alias("bin")).agg(
        *[F.avg(F.when(F.col("_obs"), F.col(f))).alias(f) for f in names],
        F.count_if("_obs").alias("_n"), flag_day("Start").alias("_s"), flag_day("End").alias("_e"),
    )
    present = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in names), F.lit(0))
    binned = binned.withColumn("valid_fraction", present / F.lit(float(len(names))))
    records = binned.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("bin", *names, "valid_fraction"))).alias("_bins"),
        F.sum("_n").cast("int").alias("num_observations"),
        F.max("_s")["doy"].alias("start_doy"), F.max("_e")["doy"].alias("end_doy"),
    ).filter(F.col("num_observations") >= min_points)
    if labelled_only:
        records = require_labels(records)
    return records.select(
        *key, tensor(F.col("_bins"), names).alias("x"), "start_doy", "end_doy", F.lit(feature_set).alias("feature_set"),
        "num_observations",
    )


def encode_targets(records: DataFrame) -> DataFrame:
    """Adds ``y``: both label days scaled by 366, 0 where a label is missing."""
    scale = lambda c: F.coalesce(F.col(c) / F.lit(366.0), F.lit(0.0)).cast("float")
    return records.withColumn("y", F.array(scale("start_doy"), scale("end_doy")))


def sort_records(records: DataFrame) -> DataFrame:
    return records.orderBy("crop", "year", "tile")
