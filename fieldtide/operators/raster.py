"""Rasters as pixel tables: mosaics, retiling, resampling, pyramids.

A pixel row is ``tile, row, col`` plus bands. A header row is ``tile, x0, y0, dx, dy, width, height`` with a negative
``dy`` for north-up tiles. No operator ever holds an image: each works on rows, and reductions are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide import constants as C
from fieldtide.functions.dates import pseudo_month_date
from fieldtide.functions.geometry import pixel_to_xy
from fieldtide.functions.text import tile_i, tile_j, tile_name
from fieldtide.operators import spatial


def any_signal(bands: Sequence[str]) -> Column:
    out = F.col(bands[0]) > 0
    for b in bands[1:]:
        out = out | (F.col(b) > 0)
    return out


def with_xy(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds the centre coordinates ``x``, ``y`` of each pixel."""
    h = headers.select("tile", "x0", "y0", "dx", "dy")
    xy = pixel_to_xy(*[F.col(c) for c in ("row", "col", "x0", "y0", "dx", "dy")])
    return pixels.join(h, "tile").withColumn("_xy", xy).select(
        *pixels.columns, F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y")
    )


def first_wins(pixels: DataFrame, order: Sequence[str], bands: Sequence[str], key: Sequence[str] = ("row", "col"),
               valid: Column | None = None, last: bool = False) -> DataFrame:
    """One value set per grid position: the first (or last) valid one in ``order``.

    The choice is a min (max) over a struct, so overlapping layers are reduced before the shuffle.
    """
    ok = any_signal(bands) if valid is None else valid
    pick = F.max if last else F.min
    entry = F.when(ok, F.struct(*order, *bands))
    return pixels.filter(ok).groupBy(*key).agg(pick(entry).alias("_v")).select(*key, *[F.col(f"_v.{b}") for b in bands])


def last_wins(pixels: DataFrame, order: Sequence[str], bands: Sequence[str], key: Sequence[str] = ("row", "col"),
              valid: Column | None = None) -> DataFrame:
    return first_wins(pixels, order, bands, key, valid, last=True)


def box_grid(boxes: DataFrame, res_x: Column, res_y: Column) -> DataFrame:
    """Adds ``width`` and ``height`` of the pixel grid that covers each box from its upper-left corner."""
    side = lambda hi, lo, r: F.greatest(F.ceil(F.round((F.col(hi) - F.col(lo)) / r, 6)), F.lit(1)).cast("int")
    return boxes.withColumns({
        "res_x": res_x, "res_y": res_y,
        "width": side("lon_max", "lon_min", res_x), "height": side("lat_max", "lat_min", res_y),
    })


def with_tile_order(pixels: DataFrame) -> DataFrame:
    """Adds ``_ti, _tj``: tiles ``i_j`` come in the order of their numbers, other names after them."""
    far = F.lit((1 << 31) - 1)
    return pixels.withColumns({"_ti": F.coalesce(tile_i(F.col("tile")), far), "_tj": F.coalesce(tile_j(F.col("tile")), far)})


TILE_ORDER = ("_ti", "_tj", "tile")


def _targets(low: Column, high: Column, count: Column) -> Column:
    """Target positions below ``count`` whose centres lie between two edges (the lower one included), in target pixels.

    A source pixel emits these, so each target takes the one source pixel of a tile that its centre falls in.
    """
    first_at = lambda edge: F.ceil(F.round(edge - 0.5, 6)).cast("int")
    first, last = F.greatest(first_at(low), F.lit(0)), F.least(first_at(high), count) - 1
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _edges() -> dict[str, Column]:
    """Left, right, top and bottom of a pixel from its tile's header."""
    at = lambda origin, place, step: F.col(origin) + F.col(place) * F.col(step)
    left, top = at("x0", "col", "dx"), at("y0", "row", "dy")
    return {"_l": left, "_r": left + F.col("dx"), "_t": top, "_b": top + F.col("dy")}


def mosaic(
    pixels: DataFrame, headers: DataFrame, boxes: DataFrame, bands: Sequence[str], res_x: float, res_y: float,
    order: Sequence[str] = TILE_ORDER, last: bool = False, dense: bool = True, nodata: int = 0,
    request: str = "request_id", layers: Sequence[str] = (),
) -> DataFrame:
    """Pixels of the tiles that meet each box on one grid per box, clipped to the box.

    ``headers`` also carry the tile bounds. Every position takes each tile's nearest pixel; overlaps go to the first tile
    with data (or the last) in ``order``. ``layers`` (a date) are columns of both pixels and boxes that must agree. With
    ``dense`` every position of the box is returned and uncovered ones hold ``nodata``; the positions are generated on
    the executors, dealt by row.
    """
    key = [request, *layers]
    pairs = spatial.tiles_intersecting(headers, boxes, box_cols=key)
    grids = box_grid(boxes, F.lit(res_x), F.lit(res_y)).select(
        *key, F.col("lon_min").alias("_bx"), F.col("lat_max").alias("_by"), "width", "height"
    )
    # Everything small is joined first; the pixels meet it once, and pixels of tiles outside all boxes stop there.
    targets = pairs.join(grids, key).join(headers.select("tile", "x0", "y0", "dx", "dy"), "tile")
    placed = with_tile_order(pixels.join(targets, ["tile", *layers]).withColumns(_edges()))
    across = lambda x: (F.col(x) - F.col("_bx")) / F.lit(res_x)
    down = lambda y: (F.col("_by") - F.col(y)) / F.lit(res_y)
    keep = list(dict.fromkeys([*key, *order, *bands]))
    placed = placed.select(*keep, _targets(across("_l"), across("_r"), F.col("width")).alias("_cols"),
                           F.explode(_targets(down("_t"), down("_b"), F.col("height"))).alias("row"))
    placed = placed.select(*keep, "row", F.explode("_cols").alias("col"))
    merged = first_wins(placed, order, bands, (*key, "row", "col"), last=last)
    if not dense:
        return merged
    lines = grids.select(*key, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width")
    full = lines.repartition(*key, "row").select(*key, "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    return full.join(merged, [*key, "row", "col"], "left").select(
        *key, "row", "col", *[F.coalesce(F.col(b), F.lit(nodata)).alias(b) for b in bands]
    )


def coverage_fraction(dense_pixels: DataFrame, bands: Sequence[str], key: Sequence[str] = ("request_id",)) -> DataFrame:
    """Share of grid positions with data, and whether coverage is partial."""
    share = F.avg(any_signal(bands).cast("int"))
    return dense_pixels.groupBy(*key).agg(share.alias("coverage")).withColumn("partial", F.col("coverage") < 0.999999)


def valid_extent(pixels: DataFrame, bands: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows and columns spanned by pixels with any signal (upper bounds exclusive)."""
    return pixels.filter(any_signal(bands)).groupBy(*key).agg(
        F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"),
        F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"),
    )


def crop_to_extent(pixels: DataFrame, bands: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Pixels inside the valid extent, renumbered from its corner."""
    ext = valid_extent(pixels, bands, key)
    inside = F.col("row").between(F.col("row0"), F.col("row1") - 1) & F.col("col").between(F.col("col0"), F.col("col1") - 1)
    return pixels.join(ext, list(key)).filter(inside).withColumns(
        {"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}
    ).select(*pixels.columns)


def mask_to_valid(pixels: DataFrame, valid: DataFrame, sizes: DataFrame, bands: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Zero every pixel outside the valid footprint, for images whose two grids have the same size.

    ``sizes`` has one row per key with ``height, width, valid_height, valid_width``; other images pass unchanged.
    """
    k = list(key)
    marks = valid.select(*k, "row", "col").distinct().withColumn("_ok", F.lit(True))
    same = sizes.select(
        *k, ((F.col("height") == F.col("valid_height")) & (F.col("width") == F.col("valid_width"))).alias("_same")
    )
    rows = pixels.join(same, k, "left").join(marks, [*k, "row", "col"], "left")
    keep = ~F.coalesce("_same", F.lit(False)) | F.coalesce("_ok", F.lit(False))
    return rows.select(*[F.when(keep, F.col(c)).otherwise(0).alias(c) if c in bands else F.col(c) for c in pixels.columns])


def retile(
    pixels: DataFrame, headers: DataFrame, bands: Sequence[str], res_x: float, res_y: float, region: dict[str, float],
    cols: int, rows: int, order: Sequence[str] = TILE_ORDER, existing: DataFrame | None = None, extra: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Tiles cut anew into canonical cells ``i_j`` of one resolution: (pixels per cell, report on every cell).

    A position of a cell takes the nearest pixel of the first tile with signal in ``order``. A cell that already exists
    is skipped; one without tiles or with only zeros is empty and gets no rows. Cells and positions are arithmetic on
    pixel edges, so a pixel across a border serves both cells. ``extra`` columns (a date, a band) separate layers;
    ``existing`` lists cells, or cells per layer where it has those columns.
    """
    cw = (region["lon_max"] - region["lon_min"]) / cols
    ch = (region["lat_max"] - region["lat_min"]) / rows
    width, height = F.lit(max(1, round(cw / res_x))), F.lit(max(1, round(ch / res_y)))

    def cells(low: str, high: str, start: float, step: float, count: int) -> Column:
        at = lambda c: F.round((F.col(c) - F.lit(start)) / F.lit(step), 6)
        first = F.greatest(F.floor(at(low)), F.lit(0)).cast("int")
        last = F.least(F.ceil(at(high)), F.lit(count)).cast("int") - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    keep = list(dict.fromkeys([*extra, *order, *bands]))
    placed = with_tile_order(pixels.join(headers.select("tile", "x0", "y0", "dx", "dy"), "tile").withColumns(_edges()))
    placed = placed.select(*keep, "_l", "_r", "_t", "_b", F.explode(cells("_l", "_r", region["lon_min"], cw, cols)).alias("_i"))
    placed = placed.select("*", F.explode(cells("_b", "_t", region["lat_min"], ch, rows)).alias("_j"))
    across = lambda x: (F.col(x) - (F.lit(region["lon_min"]) + F.col("_i") * F.lit(cw))) / F.lit(res_x)
    down = lambda y: (F.lit(region["lat_min"]) + (F.col("_j") + 1) * F.lit(ch) - F.col(y)) / F.lit(res_y)
    placed = placed.select(*keep, tile_name(F.col("_i"), F.col("_j")).alias("cell"),
                           _targets(across("_l"), across("_r"), width).alias("_cols"),
                           F.explode(_targets(down("_t"), down("_b"), height)).alias("row"))
    placed = placed.select(*keep, "cell", "row", F.explode("_cols").alias("col"))

    wanted, done = placed, None
    if existing is not None:
        on = [c for c in ("cell", *extra) if c in existing.columns]
        done = existing.select(*on).distinct()
        wanted = placed.join(done, on, "left_anti")
    out = first_wins(wanted, order, bands, ("cell", *extra, "row", "col"))

    seen = placed.groupBy("cell", *extra).agg(
        F.count(F.lit(1)).alias("source_pixels"), F.count_if(any_signal(bands)).alias("signal_pixels")
    )
    number = F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1)))
    named = tile_name(F.floor(F.col("_n") / rows).cast("int"), F.col("_n") % rows).alias("cell")
    grid = pixels.select(*extra).distinct() if extra else pixels.sparkSession.range(1)
    grid = grid.withColumn("_n", number).select(named, *extra)
    report = grid.join(seen, ["cell", *extra], "left")
    report = report.join(done.withColumn("_done", F.lit(True)), on, "left") if done is not None else report.withColumn("_done", F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    status = F.when(F.coalesce("_done", F.lit(False)), "skipped").when(F.coalesce("signal_pixels", F.lit(0)) == 0, "empty").otherwise("wrote")
    return out, report.select("cell", *extra, count("source_pixels"), count("signal_pixels"), status.alias("status"))


def retile_bands(
    statewide: DataFrame, headers: DataFrame, year: int, month: int, day: int, res_x: float, res_y: float,
    region: dict[str, float], cols: int, rows: int, bands: Sequence[str] = C.STATEWIDE_BANDS, layers: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Retile band layers of one statewide month: long pixel rows ``tile, row, col, band, value``. Adds the pseudo date.

    The second table counts written cells per band. ``layers`` separate further images.
    """
    rows_in = statewide.filter(F.col("band").isin(*bands))
    out, report = retile(rows_in, headers, ["value"], res_x, res_y, region, cols, rows, extra=("band", *layers))
    date = pseudo_month_date(F.lit(year), F.lit(month), F.lit(day))
    counts = report.groupBy("band", *layers).agg(F.count_if(F.col("status") == "wrote").alias("wrote"))
    return out.withColumn("date", date), counts


def resample_nearest(
    pixels: DataFrame, sizes: DataFrame, key: Sequence[str] = ("tile",)
) -> DataFrame:
    """Nearest-neighbour resampling onto ``target_height`` x ``target_width``.

    Each source pixel emits the target positions whose centre falls in it: a map-only step after attaching sizes.
    Equal sizes pass through unchanged.
    """
    def span(p: str, n: str, target: str) -> Column:
        r, h, big = F.col(p), F.col(n), F.col(target)
        edge = lambda v: F.ceil((2 * v * big - h) / (2 * h)).cast("int")
        first, last = edge(r), edge(r + 1) - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    rest = [c for c in pixels.columns if c not in (*key, "row", "col")]
    rows = pixels.join(sizes.select(*key, "height", "width", "target_height", "target_width"), list(key))
    rows = rows.select(*key, *rest, "col", "width", "target_width",
                       F.explode(span("row", "height", "target_height")).alias("row"))
    return rows.select(*key, "row", F.explode(span("col", "width", "target_width")).alias("col"), *rest)


def resample_bilinear(
    pixels: DataFrame, sizes: DataFrame, bands: Sequence[str], key: Sequence[str] = ("tile",)
) -> DataFrame:
    """Bilinear resampling: each source pixel adds its weight to the targets within one source step.

    Targets near the border have fewer neighbours; the weights are renormalised. One shuffle of partial sums, no join
    between pixels.
    """
    def spread(p: str, n: str, target: str) -> Column:
        r, h, big = F.col(p).cast("double"), F.col(n).cast("double"), F.col(target).cast("double")
        first = F.greatest(F.floor((r - 0.5) * big / h - 0.5), F.lit(0)).cast("int")
        last = F.least(F.ceil((r + 1.5) * big / h - 0.5), F.col(target) - 1).cast("int")
        at = lambda t: F.lit(1.0) - F.abs((t + F.lit(0.5)) * h / big - F.lit(0.5) - r)
        return F.filter(
            F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("t"), at(t).alias("w"))),
            lambda s: s["w"] > 1e-9,
        )

    rows = pixels.join(sizes.select(*key, "height", "width", "target_height", "target_width"), list(key))
    rows = rows.select(*key, *bands, "col", "width", "target_width",
                       F.inline(spread("row", "height", "target_height")).alias("row", "_wr"))
    rows = rows.select(*key, *bands, "row", "_wr", F.inline(spread("col", "width", "target_width")).alias("col", "_wc"))
    w = F.col("_wr") * F.col("_wc")
    return rows.groupBy(*key, "row", "col").agg(
        *[(F.sum(w * F.col(b)) / F.sum(F.when(F.col(b).isNotNull(), w))).alias(b) for b in bands]
    )


def stack_bands(fine: DataFrame, coarse: DataFrame, sizes: DataFrame, bands: Sequence[str],
                key: Sequence[str] = ("tile", "date")) -> DataFrame:
    """Attach coarse bands to the fine grid, nearest by scaled index.

    ``sizes`` has ``fine_height, fine_width, coarse_height, coarse_width`` per key.
    """
    k = list(key)
    idx = lambda p, big, small: F.floor(F.col(p) * F.col(small) / F.col(big)).cast("int")
    rows = fine.join(sizes, k).withColumns({
        "_r": idx("row", "fine_height", "coarse_height"), "_c": idx("col", "fine_width", "coarse_width"),
    })
    other = coarse.select(*k, F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    return rows.join(other, [*k, "_r", "_c"]).select(*fine.columns, *bands)


def preview_size(height: Column, width: Column, max_side: int) -> tuple[Column, Column]:
    """Height and width after limiting the longest side; unchanged when it already fits."""
    longest = F.greatest(height, width)
    scale = F.lit(float(max_side)) / longest
    fit = lambda n: F.when(longest <= max_side, n).otherwise(F.greatest(F.rint(n * scale), F.lit(1.0)).cast("int"))
    return fit(height), fit(width)


def block_average(
    pixels: DataFrame, sizes: DataFrame, bands: Sequence[str], max_side: int = 4096, key: Sequence[str] = ("tile",)
) -> DataFrame:
    """Area-average reduction so that the longest side is at most ``max_side``.

    A source pixel that straddles target cells is split by area, which is exact for any factor.
    """
    def spread(p: str, n: str, target: str) -> Column:
        r, h, new = F.col(p).cast("double"), F.col(n).cast("double"), F.col(target).cast("double")
        lo, hi = r * new / h, (r + 1.0) * new / h
        first = F.floor(F.round(lo, 9)).cast("int")
        last = F.greatest(F.least(F.ceil(F.round(hi, 9)).cast("int") - 1, F.col(target) - 1), first)
        return F.filter(
            F.transform(
                F.sequence(first, last),
                lambda t: F.struct(t.alias("t"), (F.least(hi, t + F.lit(1.0)) - F.greatest(lo, t.cast("double"))).alias("w")),
            ),
            lambda s: s["w"] > 1e-9,
        )

    new_h, new_w = preview_size(F.col("height"), F.col("width"), max_side)
    s = sizes.select(*key, "height", "width", new_h.alias("_nh"), new_w.alias("_nw"))
    rows = pixels.join(s, list(key))
    rows = rows.select(*key, *bands, "col", "width", "_nw", F.inline(spread("row", "height", "_nh")).alias("row", "_wr"))
    rows = rows.select(*key, *bands, "row", "_wr", F.inline(spread("col", "width", "_nw")).alias("col", "_wc"))
    w = F.col("_wr") * F.col("_wc")
    return rows.groupBy(*key, "row", "col").agg(*[(F.sum(w * F.col(b)) / F.sum(w)).alias(b) for b in bands])


def overviews(
    pixels: DataFrame, sizes: DataFrame, bands: Sequence[str], key: Sequence[str] = ("tile",),
    factors: Sequence[int] = C.OVERVIEW_FACTORS, min_side: int = C.OVERVIEW_MIN_SIDE,
) -> DataFrame:
    """Average pyramid: one level per factor that leaves the longer side at ``min_side`` or more.

    All levels come from one aggregate; partial sums collapse neighbouring pixels before the shuffle.
    """
    longest = F.greatest("height", "width")
    kept = F.filter(F.array(*[F.lit(f) for f in factors]), lambda f: F.floor(longest / f) >= min_side)
    levels = sizes.select(*key, kept.alias("_f"))
    rows = pixels.join(levels, list(key)).select(*key, "row", "col", *bands, F.explode("_f").alias("factor"))
    down = lambda c: F.floor(F.col(c) / F.col("factor")).cast("int")
    return rows.groupBy(*key, "factor", down("row").alias("row"), down("col").alias("col")).agg(
        *[F.avg(b).alias(b) for b in bands]
    )


def overlay_scenes(
    pixels: DataFrame, scenes: DataFrame, bands: Sequence[str], box: dict[str, float], max_side: int = 4096,
    key: str = "scene",
) -> tuple[DataFrame, DataFrame]:
    """Scenes on one grid over a box, later scenes on top: (pixels, skipped scenes with a reason).

    ``scenes`` holds one header per scene plus ``order`` and ``crs``. The grid takes the finest resolution of any scene and
    axis for both axes; when the longer side would exceed ``max_side``, one factor shrinks both. Values are bilinear over
    the pixels with signal in that band, rounded to whole numbers, 0 without any; validity is the nearest source pixel.
    """
    hit = scenes.filter(
        (F.col("lon_min") <= box["lon_max"]) & (F.col("lon_max") >= box["lon_min"])
        & (F.col("lat_min") <= box["lat_max"]) & (F.col("lat_max") >= box["lat_min"])
    )
    wide, tall = box["lon_max"] - box["lon_min"], box["lat_max"] - box["lat_min"]
    # Scalar subqueries over the headers: one number each, shared by all rows without a join.
    finest = hit.agg(F.min(F.least(F.abs("dx"), F.abs("dy")))).scalar()
    whole = lambda n: F.greatest(F.ceil(F.round(n, 6)), F.lit(1)).cast("int")
    full_w, full_h = whole(F.lit(wide) / finest), whole(F.lit(tall) / finest)
    shrink = F.greatest(F.greatest(full_w, full_h) / F.lit(float(max_side)), F.lit(1.0))
    heads = hit.withColumns({"_W": whole(full_w / shrink), "_H": whole(full_h / shrink)})
    rows = pixels.join(heads.select(key, "x0", "y0", "dx", "dy", "order", "_W", "_H"), key)

    tx, ty = F.lit(wide) / F.col("_W"), F.lit(tall) / F.col("_H")
    # Source centre in target pixel units, and source steps per target pixel.
    sx, sy = F.col("dx") / tx, -F.col("dy") / ty
    cx = (F.col("x0") + (F.col("col") + 0.5) * F.col("dx") - box["lon_min"]) / tx
    cy = (F.lit(box["lat_max"]) - (F.col("y0") + (F.col("row") + 0.5) * F.col("dy"))) / ty

    def spread(centre: Column, step: Column, limit: str) -> Column:
        first = F.greatest(F.floor(centre - step - 0.5), F.lit(0)).cast("int")
        last = F.least(F.ceil(centre + step - 0.5), F.col(limit) - 1).cast("int")
        near = lambda t: F.abs(t + F.lit(0.5) - centre) / step
        hits = F.transform(F.sequence(first, last), lambda t: F.struct(
            t.alias("t"), (F.lit(1.0) - near(t)).alias("w"),
            ((t + F.lit(0.5) - centre >= -step / 2) & (t + F.lit(0.5) - centre < step / 2)).alias("own"),
        ))
        return F.when(first <= last, F.filter(hits, lambda s: (s["w"] > 1e-9) | s["own"])).otherwise(
            F.array().cast("array<struct<t:int,w:double,own:boolean>>"))

    rows = rows.select(key, "order", *bands, "_H", cy.alias("_cy"), sy.alias("_sy"),
                       F.inline(spread(cx, sx, "_W")).alias("col", "_wc", "_oc"))
    rows = rows.select(key, "order", *bands, "col", "_wc", "_oc",
                       F.inline(spread(F.col("_cy"), F.col("_sy"), "_H")).alias("row", "_wr", "_or"))
    signal = any_signal(bands)
    w = F.greatest(F.col("_wc"), F.lit(0.0)) * F.greatest(F.col("_wr"), F.lit(0.0))
    mean = lambda b: F.try_divide(F.sum(F.when(F.col(b) > 0, w * F.col(b))), F.sum(F.when(F.col(b) > 0, w)))
    per_scene = rows.groupBy(key, "order", "row", "col").agg(
        *[F.coalesce(F.floor(F.round(mean(b), 6) + 0.5), F.lit(0)).cast("int").alias(b) for b in bands],
        F.max((F.col("_oc") & F.col("_or") & signal).cast("int")).alias("_valid"),
    )
    merged = last_wins(per_scene, ("order", key), bands, ("row", "col"), F.col("_valid") == 1)
    used = per_scene.filter("_valid = 1").select(key).distinct()
    skipped = hit.join(used, key, "left_anti").select(key, F.lit("no_valid_pixels").alias("reason")).unionByName(
        scenes.join(hit.select(key), key, "left_anti").select(key, F.lit("outside_box").alias("reason"))
    )
    return merged, skipped


def preview(
    pixels: DataFrame, headers: DataFrame, boxes: DataFrame, bands: Sequence[str], res_x: float, res_y: float,
    max_side: int = 4096, layers: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Mosaic, crop to the valid extent, reduce and stretch: (display pixels, statistics per stage and channel)."""
    from fieldtide.operators import quality, stretch

    key = ["request_id", *layers]
    whole = mosaic(pixels, headers, boxes, bands, res_x, res_y, layers=layers)
    cropped = crop_to_extent(whole, bands, key)
    size = valid_extent(whole, bands, key).select(
        *key, (F.col("row1") - F.col("row0")).alias("height"), (F.col("col1") - F.col("col0")).alias("width")
    )
    small = block_average(cropped, size, bands, max_side, key)
    small = small.select(*key, "row", "col", *[F.rint(F.round(b, 9)).cast("int").alias(b) for b in bands])
    shown = stretch.display_stretch(small, bands, key)
    stage = lambda df, name: quality.channel_stats(df, bands, key).withColumn("stage", F.lit(name))
    stats = stage(whole, "mosaic").unionByName(stage(cropped, "cropped")).unionByName(
        stage(small, "reduced")).unionByName(stage(shown, "display"))
    return shown, stats
