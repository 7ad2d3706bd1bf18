"""Boxes, tiles and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtide import constants as C
from fieldtide.functions.geometry import boxes_overlap, grid_edge
from fieldtide.functions.text import tile_i, tile_j, tile_name
from fieldtide.operators.stats import exact_medians

BOUNDS = ("lon_min", "lat_min", "lon_max", "lat_max")


def _cols(prefix: str) -> dict[str, Column]:
    return {b: F.col(f"{prefix}.{b}") for b in BOUNDS}


def tiles_intersecting(
    tiles: DataFrame, boxes: DataFrame, tile_cols: Sequence[str] = ("tile",), box_cols: Sequence[str] = ("request_id",),
    cell_lon: float | None = None, cell_lat: float | None = None, on: Sequence[str] = (),
) -> DataFrame:
    """Pairs of a tile and a box that overlap, edges included.

    Both sides are listed in every cell of a coarse lattice they touch, and the join is an equi-join on the cell, so
    it can broadcast, hash or sort-merge, and adaptive execution can split a crowded cell. A pair sharing several
    cells is kept only in the cell that holds the lower-left corner of the overlap, so no distinct is needed.
    ``on`` names further equality columns, such as the year.
    """
    sx = cell_lon or (C.REGION["lon_max"] - C.REGION["lon_min"]) / C.GRID_N
    sy = cell_lat or (C.REGION["lat_max"] - C.REGION["lat_min"]) / C.GRID_N

    def lattice(df: DataFrame, keep: Sequence[str], side: str) -> DataFrame:
        cell = lambda c, s: F.floor(F.col(c) / F.lit(s)).cast("bigint")
        x0, x1, y0, y1 = cell("lon_min", sx), cell("lon_max", sx), cell("lat_min", sy), cell("lat_max", sy)
        rows = df.select(*keep, *on, *BOUNDS, x0.alias(f"_x_{side}"), y0.alias(f"_y_{side}"),
                         F.explode(F.sequence(x0, x1)).alias("_cx"), y1.alias("_y1"))
        return rows.select(*[c for c in rows.columns if c != "_y1"],
                           F.explode(F.sequence(F.col(f"_y_{side}"), F.col("_y1"))).alias("_cy"))

    t = lattice(tiles, tile_cols, "t").alias("t")
    b = lattice(boxes, box_cols, "b").alias("b")
    same = [F.col(f"t.{c}") == F.col(f"b.{c}") for c in ("_cx", "_cy", *on)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    owner = (F.col("t._cx") == F.greatest("t._x_t", "b._x_b")) & (F.col("t._cy") == F.greatest("t._y_t", "b._y_b"))
    pairs = t.join(b, cond & owner & boxes_overlap(_cols("t"), _cols("b")))
    return pairs.select(*[F.col(f"b.{c}") for c in (*box_cols, *on)], *[F.col(f"t.{c}") for c in tile_cols])


def make_grid(spark: SparkSession, region: dict[str, float] = C.REGION, cols: int = C.GRID_N, rows: int = C.GRID_N) -> DataFrame:
    """Even cells ``i_j`` of a region, ``i`` along longitude and ``j`` along latitude."""
    ids = spark.range(cols * rows)
    i, j = F.floor(F.col("id") / rows).cast("int"), (F.col("id") % rows).cast("int")
    return grid_cells(ids.select(i.alias("i"), j.alias("j")), region, cols, rows)


def grid_cells(
    indexes: DataFrame, region: dict[str, float] = C.REGION, cols: int = C.GRID_N, rows: int = C.GRID_N
) -> DataFrame:
    """Adds ``tile`` and the cell's bounds to rows carrying ``i`` and ``j``."""
    i, j = F.col("i"), F.col("j")
    return indexes.select(
        "*", tile_name(i, j).alias("tile"),
        grid_edge(i, region["lon_min"], region["lon_max"], cols).alias("lon_min"),
        grid_edge(j, region["lat_min"], region["lat_max"], rows).alias("lat_min"),
        grid_edge(i + 1, region["lon_min"], region["lon_max"], cols).alias("lon_max"),
        grid_edge(j + 1, region["lat_min"], region["lat_max"], rows).alias("lat_max"),
    )


def subregions(boxes: DataFrame, n: int) -> DataFrame:
    """Split each box into ``n`` x ``n`` even parts; ``n <= 1`` returns the box itself as part 0_0."""
    n = max(1, n)
    span = F.sequence(F.lit(0), F.lit(n - 1))
    rows = boxes.withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    i, j = F.col("i"), F.col("j")
    part = {
        "lon_min": grid_edge(i, F.col("lon_min"), F.col("lon_max"), n),
        "lat_min": grid_edge(j, F.col("lat_min"), F.col("lat_max"), n),
        "lon_max": grid_edge(i + 1, F.col("lon_min"), F.col("lon_max"), n),
        "lat_max": grid_edge(j + 1, F.col("lat_min"), F.col("lat_max"), n),
    }
    return rows.withColumns({**part, "part": tile_name(i, j)}).drop("i", "j")


def grid_cells_for_bbox(
    boxes: DataFrame, region: dict[str, float] = C.REGION, n: int = C.GRID_N, keep: Sequence[str] = ("request_id",)
) -> DataFrame:
    """Cells of the ``n`` x ``n`` grid each box touches, edges included.

    The candidate index range comes from arithmetic, one cell wider on both sides; the exact edge test decides. No
    join is involved.
    """
    def span(low: str, high: str, a: str, b: str) -> Column:
        step = (region[b] - region[a]) / n
        first = F.floor((F.col(low) - F.lit(region[a])) / F.lit(step)).cast("int") - 1
        last = F.floor((F.col(high) - F.lit(region[a])) / F.lit(step)).cast("int") + 1
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    rows = boxes.select(*keep, *[F.col(b).alias(f"_{b}") for b in BOUNDS], F.explode(
        span("lon_min", "lon_max", "lon_min", "lon_max")).alias("i"), F.struct(*BOUNDS).alias("_box"))
    rows = rows.select("*", F.explode(span("_box.lat_min", "_box.lat_max", "lat_min", "lat_max")).alias("j"))
    cells = grid_cells(rows, region, n, n)
    box = {b: F.col(f"_{b}") for b in BOUNDS}
    cell = {b: F.col(b) for b in BOUNDS}
    return cells.filter(boxes_overlap(cell, box)).select(*keep, "i", "j", "tile", *BOUNDS)


def adaptive_grid_size(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column,
                       target_w: float, target_h: float, max_n: int) -> Column:
    """Columns and rows that keep cells near the target size; the default region always keeps its canonical grid."""
    def count(lo: Column, hi: Column, target: float) -> Column:
        extent = F.greatest(hi - lo, F.lit(0.0))
        return F.greatest(F.least(F.ceil(extent / F.lit(target)), F.lit(max_n)), F.lit(1)).cast("int")

    cols, rows = count(lon_min, lon_max, target_w), count(lat_min, lat_max, target_h)
    if max_n >= C.GRID_N:
        default = (
            (lon_min == C.REGION["lon_min"]) & (lat_min == C.REGION["lat_min"])
            & (lon_max == C.REGION["lon_max"]) & (lat_max == C.REGION["lat_max"])
        )
        cols = F.when(default, C.GRID_N).otherwise(cols)
        rows = F.when(default, C.GRID_N).otherwise(rows)
    return F.struct(cols.alias("grid_cols"), rows.alias("grid_rows"))


def grid_layout_check(wanted: DataFrame, existing: DataFrame, unlabelled: DataFrame, now: Column) -> DataFrame:
    """Compare wanted grid layouts with what a folder already holds.

    ``unlabelled`` lists folders with tiles but no stored layout: those accept only the canonical grid. Adds
    ``violation`` (null when fine) and the creation time to store, which keeps the first one.
    """
    six = lambda p: F.array(*[F.round(F.col(f"{p}{b}"), 6) for b in BOUNDS])
    old = existing.select(
        "folder", F.col("grid_cols").alias("_c"), F.col("grid_rows").alias("_r"),
        *[F.col(b).alias(f"_{b}") for b in BOUNDS], F.col("created_at").alias("_created"), F.lit(True).alias("_known"),
    )
    rows = wanted.join(old, "folder", "left").join(
        unlabelled.select("folder", F.lit(True).alias("_tiles")), "folder", "left"
    )
    known = F.coalesce("_known", F.lit(False))
    differs = ~((F.col("_c") == F.col("grid_cols")) & (F.col("_r") == F.col("grid_rows")) & (six("_") == six("")))
    bare = ~known & F.coalesce("_tiles", F.lit(False)) & (
        (F.col("grid_cols") != C.GRID_N) | (F.col("grid_rows") != C.GRID_N)
    )
    violation = F.when(known & F.coalesce(differs, F.lit(True)), "layout_mismatch").when(bare, "unlabelled_tiles")
    return rows.select(
        *wanted.columns, violation.alias("violation"), F.coalesce("_created", now).alias("created_at")
    )


def region_guard(boxes: DataFrame, region: dict[str, float] = C.REGION) -> DataFrame:
    """Adds ``violation``: an empty box or one outside the covered region."""
    outside = (
        (F.col("lon_max") < region["lon_min"]) | (F.col("lon_min") > region["lon_max"])
        | (F.col("lat_max") < region["lat_min"]) | (F.col("lat_min") > region["lat_max"])
    )
    empty = (F.col("lon_min") >= F.col("lon_max")) | (F.col("lat_min") >= F.col("lat_max"))
    return boxes.withColumn("violation", F.when(empty, "empty_box").when(outside, "outside_region"))


def envelope(tiles: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return tiles.groupBy(*key).agg(
        F.min("lon_min").alias("lon_min"), F.min("lat_min").alias("lat_min"),
        F.max("lon_max").alias("lon_max"), F.max("lat_max").alias("lat_max"),
    )


def select_tiles(df: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted tiles, wanted tiles that do not exist)."""
    names = wanted.select("tile").distinct()
    return df.join(names, "tile", "left_semi"), names.join(df, "tile", "left_anti")


def missing(requested: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Requested rows without a counterpart."""
    return requested.join(present, list(on), "left_anti")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def natural_tile_order(df: DataFrame, tile: str = "tile") -> DataFrame:
    """``10_2`` after ``9_3``."""
    return df.orderBy(tile_i(F.col(tile)), tile_j(F.col(tile)), F.col(tile))


def limit_tiles(tiles: DataFrame, n: int) -> DataFrame:
    """First ``n`` tiles in natural order, for smoke runs."""
    return natural_tile_order(tiles).limit(n)


def resolution_check(tiles: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Median resolution and number of reference systems; tiles without one are skipped. One row, or one per key."""
    counted = tiles.groupBy(*key).agg(F.count_distinct("crs").alias("crs_count"), F.count("crs").alias("tiles"), F.min("crs").alias("crs"))
    medians = exact_medians(tiles.filter(F.col("crs").isNotNull()), key, {"res_x": F.col("dx"), "res_y": F.col("dy")})
    out = counted.unionByName(medians, allowMissingColumns=True).groupBy(*key)
    out = out.agg(*[F.max(c).alias(c) for c in ("res_x", "res_y", "crs_count", "tiles", "crs")])
    return out.withColumn("violation", F.when(F.col("crs_count") == 0, "no_tiles").when(F.col("crs_count") > 1, "mixed_crs"))


def mosaic_size(tiles: DataFrame, res_x: Column, res_y: Column, bands: int = 3, bytes_per_value: int = 1,
                key: Sequence[str] = (), warn_gib: float = 8.0) -> DataFrame:
    """Width, height, bytes and GiB of a whole mosaic, and whether it reaches the memory warning."""
    bounds = tiles.groupBy(*key).agg(F.min("lon_min").alias("lon_min"), F.min("lat_min").alias("lat_min"),
                                     F.max("lon_max").alias("lon_max"), F.max("lat_max").alias("lat_max"))
    medians = exact_medians(tiles, key, {"_rx": res_x, "_ry": res_y})
    rows = bounds.unionByName(medians, allowMissingColumns=True).groupBy(*key).agg(*[F.max(c).alias(c) for c in (*BOUNDS, "_rx", "_ry")])
    side = lambda hi, lo, r: F.ceil((F.col(hi) - F.col(lo)) / F.greatest(F.col(r), F.lit(1e-12))).cast("bigint")
    rows = rows.withColumns({"width": side("lon_max", "lon_min", "_rx"), "height": side("lat_max", "lat_min", "_ry")})
    rows = rows.withColumn("bytes", F.col("width") * F.col("height") * bands * bytes_per_value)
    gib = F.col("bytes") / F.lit(float(1024**3))
    return rows.select(*key, "width", "height", "bytes", gib.alias("gib"), (gib >= warn_gib).alias("large"))
