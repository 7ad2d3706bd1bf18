"""Boxes, grids, affine transforms and Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6378137.0


def normalize_bbox(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    return F.struct(
        F.least(lon_a, lon_b).alias("lon_min"), F.least(lat_a, lat_b).alias("lat_min"),
        F.greatest(lon_a, lon_b).alias("lon_max"), F.greatest(lat_a, lat_b).alias("lat_max"),
    )


def parse_bbox(text: Column) -> Column:
    """``min_lon,min_lat,max_lon,max_lat`` to a struct whose ``violation`` is null when the box is good."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    lon_min, lat_min, lon_max, lat_max = (F.try_element_at(parts, F.lit(k)) for k in (1, 2, 3, 4))
    violation = (
        F.when(F.size(parts) != 4, "four_numbers_required")
        .when(F.exists(parts, lambda p: p.isNull()), "not_a_number")
        .when(lon_min >= lon_max, "longitude_range")
        .when(lat_min >= lat_max, "latitude_range")
        .when((lon_min < -180) | (lon_max > 180), "longitude_limit")
        .when((lat_min < -90) | (lat_max > 90), "latitude_limit")
    )
    return F.struct(
        lon_min.alias("lon_min"), lat_min.alias("lat_min"), lon_max.alias("lon_max"), lat_max.alias("lat_max"),
        violation.alias("violation"),
    )


def bbox_corners(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    """Upper-left, lower-left, upper-right, lower-right."""
    return F.array(
        F.array(lon_min, lat_max), F.array(lon_min, lat_min), F.array(lon_max, lat_max), F.array(lon_max, lat_min)
    )


def corners_bbox(corners: Column) -> Column:
    lons, lats = F.transform(corners, lambda p: p[0]), F.transform(corners, lambda p: p[1])
    return F.struct(
        F.array_min(lons).alias("lon_min"), F.array_min(lats).alias("lat_min"),
        F.array_max(lons).alias("lon_max"), F.array_max(lats).alias("lat_max"),
    )


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Inclusive on every edge, so touching boxes overlap."""
    return (
        (a["lon_min"] <= b["lon_max"]) & (a["lon_max"] >= b["lon_min"])
        & (a["lat_min"] <= b["lat_max"]) & (a["lat_max"] >= b["lat_min"])
    )


def ring_envelope(ring: Column) -> Column:
    """Envelope of a polygon ring given as an array of (lon, lat) structs."""
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("lon_min"), F.array_min(lats).alias("lat_min"),
        F.array_max(lons).alias("lon_max"), F.array_max(lats).alias("lat_max"),
    )


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS) * (lon * F.lit(math.pi / 180.0))


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH_RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360.0)))


def mercator_lon(x: Column) -> Column:
    return x / F.lit(EARTH_RADIUS) * F.lit(180.0 / math.pi)


def mercator_lat(y: Column) -> Column:
    return F.lit(360.0 / math.pi) * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(90.0)


def wgs84_to_mercator(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> Column:
    return F.struct(
        mercator_x(lon_min).alias("x_min"), mercator_y(lat_min).alias("y_min"),
        mercator_x(lon_max).alias("x_max"), mercator_y(lat_max).alias("y_max"),
    )


def mercator_to_wgs84(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(
        mercator_lon(x_min).alias("lon_min"), mercator_lat(y_min).alias("lat_min"),
        mercator_lon(x_max).alias("lon_max"), mercator_lat(y_max).alias("lat_max"),
    )


def pixel_to_xy(row: Column, col: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """Centre of a pixel. ``dy`` is negative for north-up rasters."""
    return F.struct((x0 + (col + F.lit(0.5)) * dx).alias("x"), (y0 + (row + F.lit(0.5)) * dy).alias("y"))


def xy_to_pixel(x: Column, y: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    return F.struct(
        F.floor((y - y0) / dy).cast("bigint").alias("row"), F.floor((x - x0) / dx).cast("bigint").alias("col")
    )


def window_for_bounds(
    x_min: Column, y_min: Column, x_max: Column, y_max: Column,
    x0: Column, y0: Column, dx: Column, dy: Column, width: Column, height: Column,
) -> Column:
    """Pixel window of a box inside a raster: clipped first, then offsets floored and lengths rounded up.

    ``valid`` is false when the box misses the raster.
    """
    col_a, col_b = (x_min - x0) / dx, (x_max - x0) / dx
    row_a, row_b = (y_max - y0) / dy, (y_min - y0) / dy
    left, right = F.greatest(col_a, F.lit(0.0)), F.least(col_b, width.cast("double"))
    top, bottom = F.greatest(row_a, F.lit(0.0)), F.least(row_b, height.cast("double"))
    snap = lambda c: F.round(c, 6)
    wide, tall = F.ceil(snap(right - left)).cast("bigint"), F.ceil(snap(bottom - top)).cast("bigint")
    return F.struct(
        F.floor(snap(left)).cast("bigint").alias("col_off"), F.floor(snap(top)).cast("bigint").alias("row_off"),
        wide.alias("width"), tall.alias("height"), ((wide > 0) & (tall > 0)).alias("valid"),
    )


def grid_edge(index: Column, low: Column | float, high: Column | float, n: int) -> Column:
    """Edge ``index`` of ``n`` even cells; the last edge is exactly ``high``."""
    lo = F.lit(low) if not isinstance(low, Column) else low
    hi = F.lit(high) if not isinstance(high, Column) else high
    return F.when(index == n, hi).otherwise(lo + index.cast("double") * ((hi - lo) / F.lit(float(n))))
