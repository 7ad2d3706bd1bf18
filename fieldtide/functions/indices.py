"""Spectral indices and pixel-level projections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldtide import constants as C

EPS = 1e-10


def clip(value: Column, low, high) -> Column:
    """Clamp to [low, high], keeping nulls (``greatest``/``least`` would skip them)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _normalised_difference(a: Column, b: Column) -> Column:
    return clip(F.try_divide(a - b, a + b + F.lit(EPS)), -1.0, 1.0)


def ndvi(nir: Column, red: Column) -> Column:
    return _normalised_difference(nir, red)


def ndwi(nir: Column, swir: Column) -> Column:
    return _normalised_difference(nir, swir)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    top = F.lit(2.5) * (nir - red)
    bottom = nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0) + F.lit(EPS)
    return clip(F.try_divide(top, bottom), -1.0, 1.0)


def all_indices(nir: Column, red: Column, blue: Column, swir: Column) -> Column:
    return F.struct(
        ndvi(nir, red).alias("ndvi"), ndwi(nir, swir).alias("ndwi"), evi(nir, red, blue).alias("evi")
    )


def swir_band(b11: Column, b12: Column) -> Column:
    return F.coalesce(b11, b12)


def reflectance(dn: Column) -> Column:
    return dn.cast("double") / F.lit(10000.0)


def scl_valid(scl: Column, policy: str = "bad", mask_water: bool = False) -> Column:
    """Usable-pixel test on the scene classification. A missing class counts as usable."""
    if policy == "bad":
        ok = ~scl.isin(*C.SCL_BAD)
    elif policy == "keep":
        codes = C.SCL_KEEP if mask_water else C.SCL_KEEP + (C.SCL_WATER,)
        ok = scl.isin(*codes)
    elif policy == "not_water":
        ok = scl != C.SCL_WATER
    elif policy == "cloud":
        ok = scl <= C.SCL_CLOUD_ABOVE
    else:
        raise ValueError(f"unknown mask policy {policy!r}")
    return F.coalesce(ok, F.lit(True))


def clamp_unsigned(value: Column, bits: int) -> Column:
    """Clamp into an unsigned range before the integer cast, so that nothing wraps."""
    return clip(value, 0, (1 << bits) - 1).cast("int")


def argmax_class(logits: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def rgb_compose(red: Column, green: Column, blue: Column, swap: bool = False) -> Column:
    bands = F.array(red, green, blue)
    return F.reverse(bands) if swap else bands


def palette_lookup(label: Column) -> Column:
    """Class label to a struct of name, r, g, b and hex. Labels outside the palette become class 0."""
    entries = []
    for code, name, r, g, b in C.PALETTE:
        entries += [
            F.lit(code),
            F.struct(
                F.lit(code).alias("label"), F.lit(name).alias("name"),
                F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"),
                F.lit(f"#{r:02x}{g:02x}{b:02x}").alias("hex"),
            ),
        ]
    table = F.create_map(*entries)
    return F.coalesce(F.try_element_at(table, label.cast("int")), F.try_element_at(table, F.lit(0)))


def round_half_even_ratio(num: Column, den: int) -> Column:
    """``round(num / den)`` with ties to even, in integer arithmetic (``num`` >= 0)."""
    whole = F.floor(num / F.lit(den)).cast("bigint")
    twice = (num - whole * den) * 2
    up = (twice > den) | ((twice == den) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0).cast("bigint")
