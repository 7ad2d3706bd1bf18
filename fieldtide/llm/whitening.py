"""Whitening of embeddings from an orthogonal reduction of their rows.

Sums of the whole-number vectors are exact. Blocks of centred rows are reduced by QR, block by block and then factor by
factor in a tree, so that the covariance is never formed and no task sees more than a few triangles. ``qd`` takes the
last triangle's singular values and right vectors; rows are projected on these in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldtide.llm import qd
from fieldtide.llm.work import saved

_SLICE = 1 << 20
_FAN = 8


def whole_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64, zero: int = 1_000_000) -> tuple[DataFrame, int]:
    """((vec_id, x), width): x = floor(scale * c) + zero of every entry.

    Rows whose vector is null or holds a null or non-finite entry are dropped; null and repeated ids stay. A shorter
    vector counts as filled up with zeros.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("c"))
    kept = kept.filter(F.col("c").isNotNull() & F.forall("c", fine))
    width = kept.agg(F.max(F.size("c"))).first()[0] or 0
    x = F.transform("c", lambda c: F.floor(c * scale) + F.lit(zero).cast("bigint"))
    padded = F.concat(x, F.array_repeat(F.lit(zero).cast("bigint"), F.lit(width) - F.size("c")))
    return kept.select("vec_id", padded.alias("x")), width


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The vectors of a batch, a bounded number of numbers at a time."""
    column, step = batch.column("x"), max(1, _SLICE // width)
    for k in range(0, len(column), step):
        yield column.slice(k, step).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Centre:
    """Rows and exact sums of the fit list. mean = whole + rest / n."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) ** 2, exact; an error where it does not fit in 64 bits."""
        moved = x - self.whole
        most = int(np.abs(moved).max(initial=0)) * self.n + self.n
        if x.shape[1] * most**2 < 1 << 63:
            return ((moved * self.n - self.rest) ** 2).sum(axis=1)
        exact = [sum(int(v) ** 2 for v in row) for row in moved.astype(object) * self.n - self.rest.astype(object)]
        if max(exact) >= 1 << 63:
            raise OverflowError("the deviation does not fit in 64 bits")
        return np.array(exact, np.int64)


def centre(fit: DataFrame, width: int) -> Centre | None:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            for x in _blocks(batch, width):
                count += len(x)
                sums += x.sum(axis=0)
        if count:
            yield pa.record_batch({"at": np.arange(-1, width, dtype=np.int32), "s": np.append(count, sums)})

    parts = fit.mapInArrow(add, "at int, s bigint").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in parts.collect()}
    return Centre(found[-1], [found[k] for k in range(width)]) if found else None


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows' QR, always square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - r.shape[0], rows.shape[1]))])


def triangle(fit: DataFrame, middle: Centre, width: int) -> np.ndarray:
    """R of all centred rows: one triangle per partition, then ``_FAN`` of them at a time become one."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for x in _blocks(batch, width):
                r = _triangle(np.vstack([r, middle.centred(x)]))
        if r.size:
            yield pa.record_batch({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("r").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // _FAN], pa.int32()),
                         "r": pa.array([_triangle(r).ravel()], pa.list_(pa.float64()))})

    parts = fit.mapInArrow(reduce, "r array<double>").select(F.spark_partition_id().alias("part"), "r")
    parts = saved(parts, "triangles")
    while parts.count() > _FAN:
        parts = parts.groupBy(F.floor(F.col("part") / _FAN)).applyInArrow(merge, "part int, r array<double>")
        parts = saved(parts, "triangles")
    return _triangle(np.array([x for row in parts.orderBy("part").collect() for x in row["r"]]).reshape(-1, width))


@dataclass
class Whitening:
    """Directions as columns, their variances (falling), and the sum of all variances."""

    middle: Centre
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    width: int

    @classmethod
    def fit(cls, fit: DataFrame, width: int, components: int = 16) -> "Whitening | None":
        """From distinct vectors ``x``; None without rows or entries. Directions without variance are left out."""
        middle = centre(fit, width) if width else None
        if middle is None:
            return None
        r = triangle(fit, middle, width)
        _, squares, directions = qd.leading(r, components)
        return cls(middle, directions, squares / middle.n, float((r**2).sum()) / middle.n, width)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.middle.centred(x) @ self.directions / np.sqrt(self.variances)

    def identity_error(self, fit: DataFrame) -> float:
        """Largest entry of the whitened fit list's covariance minus the identity."""
        size, width, middle, whiten = self.variances.size, self.width, self.middle, self.whiten

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for batch in batches:
                for x in _blocks(batch, width):
                    y = whiten(x)
                    total += y.T @ y
            yield pa.record_batch({"at": np.arange(size * size, dtype=np.int32), "s": total.ravel()})

        rows = fit.mapInArrow(products, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        found = np.zeros(size * size)
        for r in rows:
            found[r["at"]] = r["s"]
        return float(np.abs(found.reshape(size, size) / middle.n - np.eye(size)).max(initial=0))

    def rows(self, vectors: DataFrame, error: float) -> DataFrame:
        """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
        size, width, middle, whiten = self.variances.size, self.width, self.middle, self.whiten
        explained = self.variances / self.trace if size else np.zeros(0)
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for x in _blocks(batch, width):
                    ids = batch.column("vec_id").slice(done, len(x))
                    done += len(x)
                    yield pa.record_batch({
                        "vec_id": ids.take(pa.array(np.repeat(np.arange(len(x)), size))),
                        "component": np.tile(np.arange(1, size + 1, dtype=np.int32), len(x)),
                        "n": np.full(len(x) * size, middle.n), "deviation": np.repeat(middle.deviation(x), size),
                        "whitened": whiten(x).ravel(), "explained": np.tile(explained, len(x)),
                        "identity_error": np.full(len(x) * size, error),
                    })

        return vectors.mapInArrow(project, schema)


def whitened_rows(rows: DataFrame, components: int = 16, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Every remaining row of ``whole_vectors`` on up to ``components`` whitened components, fitted to the distinct vectors.

    Rows repeat as they do in the input. Without rows, entries or any variance there are no components and no rows.
    Equal variances leave their directions open up to a rotation.
    """
    vectors, width = whole_vectors(rows, vector, vec_id)
    fit = saved(vectors.select("x").distinct(), "whitening-fit")
    model = Whitening.fit(fit, width, components)
    if model is None:
        model = Whitening(Centre(1, []), np.zeros((0, 0)), np.zeros(0), 0.0, 1)
        return model.rows(vectors.filter("false"), 0.0)
    return model.rows(vectors, model.identity_error(fit))
