"""Whitening against a plain eigen-decomposition, and its solver on matrices of known difficulty."""

import numpy as np
import pytest
from pyspark import cloudpickle

import fieldtide
from fieldtide.llm import qd
from fieldtide.llm.whitening import whitened_rows

cloudpickle.register_pickle_by_value(fieldtide)
SCHEMA = "vec_id bigint, embedding array<float>, x string, n int"
RNG = np.random.default_rng(1)


def turned(values):
    u, v = (np.linalg.qr(RNG.normal(size=(len(values), len(values))))[0] for _ in range(2))
    return u @ np.diag(values) @ v


CASES = {
    "gauss": np.linalg.qr(RNG.normal(size=(900, 48)), mode="r"),
    "graded": np.linalg.qr(RNG.normal(size=(900, 48)) * np.logspace(0, -8, 48), mode="r"),
    "identity": np.eye(40),
    **{f"multiple {k}": turned([5.0] * 6 + [3.0] * 10 + [1.0] * 24) for k in range(20)},
    **{f"one value {k}": turned([2.0] * 30) for k in range(5)},
    "clustered": turned(np.concatenate([1 + np.arange(20) * 1e-13, np.arange(2, 22)])),
    "rank one": np.ones((9, 9)),
    "zero columns": np.triu(RNG.normal(size=(20, 20))) * (np.arange(20) % 3 > 0),
    "one": np.array([[3.0]]),
    "nothing": np.zeros((5, 5)),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    matrix = CASES[name]
    squares, values, v = qd.leading(matrix, 16)
    expected = np.linalg.svd(matrix, compute_uv=False)
    assert np.abs(np.sqrt(squares) - expected).max() <= 1e-13 * max(expected[0], 1e-300)
    assert v.shape[1] == min(16, int((expected > 1e-13 * expected[0]).sum()))
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-11
    assert np.abs(matrix.T @ (matrix @ v) - v * values).max(initial=0) <= 1e-11 * max(squares[0], 1e-300)


def test_graded_values_keep_their_relative_accuracy():
    squares = qd.squared_values(np.logspace(0, -12, 13), np.full(12, 1e-14))
    assert np.abs(np.sqrt(squares) / np.logspace(0, -12, 13) - 1).max() < 1e-3
    assert np.all(np.diff(squares) < 0)


def plain(rows, components=16):
    width = max((len(v) for _, v in rows if v is not None), default=0)
    fine = [(k, v + [0.0] * (width - len(v))) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in fine], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    keep = min(components, int((values > 1e-9 * values[0]).sum()))
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return [k for k, _ in fine], deviation, (x - sums / n) @ directions[:, :keep] / np.sqrt(values[:keep]), values[:keep] / values.sum(), n


def compare(spark, rows):
    table = spark.createDataFrame([(k, v, "extra", 3) for k, v in rows], SCHEMA).repartition(5)
    got = whitened_rows(table).collect()
    ids, deviation, whitened, explained, n = plain(rows)
    k = len(explained)
    assert len(got) == k * len(ids)
    parts = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        parts.setdefault(r["component"], []).append((r["vec_id"] is not None, r["vec_id"], r["deviation"], r["whitened"]))
    key = lambda r: tuple((v is not None, v) for v in r[:3])
    for c in range(k):
        mine = sorted(parts[c + 1], key=key)
        plain_rows = sorted(((i is not None, i, d, w) for i, d, w in zip(ids, deviation, whitened[:, c])), key=key)
        assert [r[:3] for r in mine] == [r[:3] for r in plain_rows]
        a, b = (np.array([r[3] for r in rows]) for rows in (mine, plain_rows))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_rows(spark):
    vectors = [[float(x) for x in RNG.normal(size=24) * np.linspace(2, 0.3, 24)] for _ in range(400)]
    rows = list(enumerate(vectors)) + [(1000 + k, vectors[0]) for k in range(300)] + [(3, vectors[7]), (3, vectors[7]), (None, vectors[9])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 22), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23)]
    rows += [(2004, [0.5, -0.25]), (2005, [])]
    compare(spark, rows)


def test_few_rows_and_constant_entries(spark):
    compare(spark, [(k, [float(k * k % 7), 1.0, -1.0, float(k % 3)]) for k in range(12)])
    compare(spark, [(k, [float(x) for x in RNG.normal(size=20)]) for k in range(6)])


@pytest.mark.parametrize("rows", [[], [(1, None, "x", 1)], [(1, [], "x", 1)], [(1, [1.0, 2.0], "x", 1)], [(k, [1.0], "x", 1) for k in range(9)]])
def test_nothing_to_whiten(spark, rows):
    assert whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect() == []
