"""Whitening against numpy's eigenvectors and whole-number arithmetic."""

import numpy as np
import pytest

from quillon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors, schema=SCHEMA, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], schema).repartition(parts)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1), c, e[::-1], u[:, ::-1]


@pytest.mark.parametrize(("rows", "dim", "parts"), [(500, 12, 40), (90, 5, 3), (60, 7, 1)])
def test_whiten(spark, rows, dim, parts):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((rows, dim)) * np.linspace(0.01, 3, dim) + rng.standard_normal(dim)
    vectors[3], vectors[5] = 0, vectors[4]
    n, deviation, c, e, u = brute(vectors)
    odd = [None, [None] * dim, [float("nan")] + [0] * (dim - 1), [float("inf")] + [0] * (dim - 1), [1.0], []]
    df = table(spark, [*vectors, *odd], parts=parts).selectExpr("*", "1 as n", "2 as component")
    found = sorted(whitening.whiten(df).collect())
    k = min(8, dim)
    assert [(r.vec_id, r.component) for r in found] == [(i, j) for i in range(rows) for j in range(1, k + 1)]
    assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in found)
    got, want = np.array([r.whitened for r in found]).reshape(rows, k), c @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9
    assert np.allclose([r.explained for r in found[:k]], e[:k] / e.sum(), rtol=1e-10) and found[0].identity_error < 1e-10


def test_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    x = np.random.default_rng(5).standard_normal((70, 4))
    got = sorted(whitening.whiten(table(spark, x, parts=9)).collect())
    n, _, c, e, u = brute(x)
    want = c @ u / np.sqrt(e)
    got = np.array([r.whitened for r in got]).reshape(70, 4)
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9


def test_jacobi():
    rng = np.random.default_rng(6)
    for dim in (1, 2, 5, 33):
        a = rng.standard_normal((60, dim)) * np.logspace(0, -9, dim)
        values, axes = whitening.jacobi(np.linalg.qr(a, mode="r"))
        assert np.allclose(values, np.linalg.svd(a, compute_uv=False), rtol=1e-9) and np.abs(axes.T @ axes - np.eye(dim)).max() < 1e-13
        assert np.abs(a.T @ a @ axes - axes * values**2).max() < 1e-13 * values[0] ** 2
    values, axes = whitening.jacobi(np.ones((3, 3)))
    assert np.allclose(values, [3, 0, 0]) and np.abs(axes.T @ axes - np.eye(3)).max() < 1e-13


def test_without_variance(spark):
    for vectors in ([[1, 2, 3]], [[1, 2, 3]] * 4):
        rows = whitening.whiten(table(spark, vectors)).collect()
        assert len(rows) == 3 * len(vectors) and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in rows)
    rows = whitening.whiten(table(spark, [[1, 0], [2, 0], [4, 0]])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-12
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [[], []])).count() == 0


def test_deviation_beyond_a_long(spark):
    far = 3.0e6
    rows = whitening.whiten(table(spark, [[far, 0], [-far, 0], [0, 1]] * 2, "vec_id long, embedding array<double>")).collect()
    x = np.array([[far * 1024, 0], [-far * 1024, 0], [0, 1024]] * 2).astype(np.int64) + 100000
    want = [sum((6 * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x]
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in rows)
    huge = whitening.whiten(table(spark, [[1e300, 0], [-1e300, 1], [0, 2]], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and {r.deviation for r in huge} >= {None}
