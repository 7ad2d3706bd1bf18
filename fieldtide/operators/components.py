"""Connected fields inside a crop mask."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide.session import ensure_checkpoint_dir

_SHIFT = 1 << 31
_BLOCK = 256
_EDGES = 1 << 16  # of a checkpoint's file, at least where there are as many


def pixel_runs(mask: DataFrame, group: Sequence[str] = ("tile", "label")) -> DataFrame:
    """Adds ``node``: the id of the horizontal run each pixel belongs to (row and first column of the run).

    A window partition is one raster row of one class.
    """
    w = W.partitionBy(*group, "row").orderBy("col")
    rows = mask.withColumn("_new", F.coalesce(F.lag("col").over(w) != F.col("col") - 1, F.lit(True)))
    start = F.last(F.when(F.col("_new"), F.col("col")), ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return rows.withColumn("_start", start).select(
        *mask.columns, (F.col("row").cast("bigint") * _SHIFT + F.col("_start")).alias("node")
    )


def run_table(mask: DataFrame, group: Sequence[str] = ("tile", "label")) -> DataFrame:
    """(group, row, first, last): the horizontal runs of a mask, one row each."""
    w = W.partitionBy(*group, "row").orderBy("col")
    island = mask.select(*group, "row", "col", (F.col("col") - F.row_number().over(w)).alias("_island"))
    return island.groupBy(*group, "row", "_island").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_island")


def run_edges(runs: DataFrame, group: Sequence[str] = ("tile", "label")) -> DataFrame:
    """Pairs (u, v), u < v, of runs of neighbouring rows whose columns overlap.

    Runs meet by blocks of ``_BLOCK`` columns: a long run is in several, and an overlap counts in the block in which it
    begins, so a block of two rows holds a bounded number of runs and no pair comes twice.
    """
    node = (F.col("row").cast("bigint") * _SHIFT + F.col("first")).alias("node")
    block = F.explode(F.sequence(F.floor(F.col("first") / _BLOCK), F.floor(F.col("last") / _BLOCK))).alias("_block")
    rows = runs.select(*group, "row", "first", "last", node, block)
    above = rows.select(*group, (F.col("row") + 1).alias("row"), "_block", F.col("first").alias("_a"), F.col("last").alias("_b"), F.col("node").alias("u"))
    pairs = rows.join(above, [*group, "row", "_block"])
    meets = (F.col("first") <= F.col("_b")) & (F.col("_a") <= F.col("last"))
    begins = F.floor(F.greatest("first", "_a") / _BLOCK) == F.col("_block")
    return pairs.filter(meets & begins).select(*group, "u", F.col("node").alias("v"))


def _contract(names: list[str]):
    """Edges of each batch as stars around the smallest node of their component in that batch."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(c).to_numpy() for c in ("u", "v"))
            group = np.zeros(u.size, np.int64)
            for name in names:
                codes = batch.column(name).dictionary_encode()
                at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                group = np.unique(group * (len(codes.dictionary) + 1) + at, return_inverse=True)[1]
            order = np.lexsort((np.concatenate([u, v]), np.tile(group, 2)))
            g, n = np.tile(group, 2)[order], np.concatenate([u, v])[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (n[1:] != n[:-1])])
            ids = np.empty(order.size, np.int64)
            ids[order] = np.cumsum(new) - 1
            a, b = ids[: u.size], ids[u.size :]
            root = np.arange(int(new.sum()))
            while True:
                low = np.minimum(root[a], root[b])
                if np.array_equal(root[a], root[b]):
                    break
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                root = root[root]
            first = order[new]  # an edge end that stands for each node
            rest = np.flatnonzero(root != np.arange(root.size))
            at = first[rest] % max(1, u.size)
            out = {name: batch.column(name).take(pa.array(at)) for name in names}
            value = n[new]
            yield pa.RecordBatch.from_pydict({**out, "u": pa.array(value[root[rest]]), "v": pa.array(value[rest])})

    return contract


def contracted(edges: DataFrame, group: Sequence[str] = ("tile", "label"), band: int = 1024) -> DataFrame:
    """Fewer edges of the same components: what a task sees of a band of rows becomes stars, before any round.

    Any part of the edges may be contracted by itself, so neither the bands nor the batches matter for the result.
    """
    rows = edges.repartition(*group, F.floor(F.col("v") / (_SHIFT * band))).sortWithinPartitions(*group, "v")
    return rows.mapInArrow(_contract(list(group)), rows.schema)


def _large_star(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(*group, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*group, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    rows = both.join(least, [*group, "u"]).filter(F.col("v") > F.col("u"))
    return _links(rows.select(*group, F.col("m").alias("u"), "v"))


def _small_star(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges are stored with u < v."""
    least = edges.groupBy(*group, "v").agg(F.min("u").alias("m"))
    rows = edges.join(least, [*group, "v"])
    to_least = rows.select(*group, F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(*group, F.col("m").alias("u"), "v")
    return _links(to_least.unionByName(own))


def _links(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("u") < F.col("v")).distinct()


def roots(edges: DataFrame, group: Sequence[str] = ("tile", "label")) -> DataFrame:
    """(group, node, root) for every node with an edge; the root is the smallest node of its component.

    Alternates the two star steps until the edge set stops changing, which takes O(log^2) rounds at worst. Each round is cut with a reliable checkpoint, so a lost executor costs one round. Minima are
    partial aggregates and a hub's edges are split by adaptive skew joins; no group is gathered in one task.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*group, "u", "v").cast("decimal(38,0)"))).first())
    current = edges.checkpoint()
    seen = mark(current)
    while True:
        # No round makes more edges than there were, so few edges need no file for each shuffle partition.
        files = int(seen[0]) // _EDGES + 1
        current = _small_star(_large_star(current, group), group).coalesce(files).checkpoint()
        now = mark(current)
        if now == seen:
            return current.select(*group, F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now


def connected_components(mask: DataFrame, group: Sequence[str] = ("tile", "label")) -> DataFrame:
    """Adds ``component`` to every labelled pixel: 4-neighbour components inside one tile and one class.

    Components are ordered as a row-by-row scan first meets them.
    """
    kept = mask.filter(F.col("label") != 0)
    ensure_checkpoint_dir(mask.sparkSession)
    runs = run_table(kept, group).checkpoint()
    found = roots(contracted(run_edges(runs, group), group), group)
    # Pixels are met again only here, to name their runs.
    return pixel_runs(kept, group).join(found, [*group, "node"], "left").select(
        *mask.columns, F.coalesce("root", "node").alias("component")
    )


def farms(components: DataFrame, headers: DataFrame, min_pixels: int = 15) -> DataFrame:
    """Fields of at least ``min_pixels``: size, centre and ``farm_id`` from the truncated centre coordinates.

    When two fields of a tile and class get the same id the later one in scan order wins.
    """
    g = ["tile", "label", "component"]
    sized = components.groupBy(*g).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col")
    ).filter(F.col("pixels") >= min_pixels)
    rows = sized.join(headers.select("tile", "x0", "y0", "dx", "dy"), "tile")
    x = F.round(F.col("x0") + (F.col("centre_col") + 0.5) * F.col("dx"), 9)
    y = F.round(F.col("y0") + (F.col("centre_row") + 0.5) * F.col("dy"), 9)
    named = rows.withColumns({"x": x, "y": y}).withColumn("farm_id", farm_id(F.col("x"), F.col("y")))
    last = F.max(F.struct("component", "pixels", "centre_row", "centre_col", "x", "y"))
    return named.groupBy("tile", "label", "farm_id").agg(last.alias("_l")).select("tile", "label", "farm_id", "_l.*")


def farm_id(x: Column, y: Column) -> Column:
    """Coordinates truncated toward zero."""
    return F.concat_ws("_", x.cast("bigint").cast("string"), y.cast("bigint").cast("string"))


def farm_pixels(components: DataFrame, found: DataFrame, crops: DataFrame) -> DataFrame:
    """Pixels of the kept fields with crop name and ``farm_id``."""
    rows = components.join(found.select("tile", "label", "component", "farm_id"), ["tile", "label", "component"])
    return rows.join(crops.select("label", "crop"), "label").select("tile", "row", "col", "crop", "farm_id")
