"""Whitening against numpy's eigenvectors, exact sums by Python integers, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from trustlake.llm import whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, v int, n int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, "c") for k, v in enumerate(vectors)], VECTORS).repartition(3)


def brute(vectors):
    """x, whitened and explained by numpy; deviations by Python integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array(x, dtype=float) - np.array(sums) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred @ parts[:, ::-1] / np.sqrt(np.abs(values[::-1])), values[::-1] / values.sum()


def compare(rows, vectors, k):
    deviation, whitened, explained = brute(vectors)
    got = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(-1, k)
    sign = np.sign((got * whitened[:, :k]).sum(axis=0))
    assert np.abs(got * sign - whitened[:, :k]).max() < 1e-9
    assert {(r.vec_id, r.deviation) for r in rows} == set(enumerate(deviation))
    for r in rows:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.n == len(vectors) and r.identity_error < 1e-9


def test_table(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = whitening.op11_whitening(spark, SF).collect()
    assert len(rows) == 8 * len(vectors) and sorted({r.vec_id for r in rows}) == list(range(len(vectors)))
    compare(rows, vectors, 8)


def test_few_dimensions_and_long_vectors(spark):
    rng = np.random.default_rng(3)
    small = (rng.normal(size=(40, 3)) * [3, 1, 0.2]).tolist()
    compare(whitening.whiten(table(spark, small)).collect(), small, 3)
    long = (rng.normal(size=(200, 120)) * np.linspace(1, 9, 120)).tolist()
    compare(whitening.whiten(table(spark, long)).collect(), long, 8)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    fine = rng.normal(size=(30, 4)).tolist()
    fine += fine[:5] + [[0.0] * 4]
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = whitening.whiten(table(spark, fine + odd).union(table(spark, []))).collect()
    compare(rows, fine, 4)
    with_null = table(spark, fine).selectExpr("IF(vec_id = 0, NULL, vec_id) AS vec_id", "embedding")
    assert sum(r.vec_id is None for r in whitening.whiten(with_null).collect()) == 4


def test_without_spread(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None, []]):
        assert whitening.whiten(table(spark, vectors)).collect() == []
    line = [[float(k), 2.0 * k, 5.0] for k in range(10)]
    rows = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1)


def test_huge_entries(spark):
    vectors = [[1e308, -1e308], [1.0, 2.0], [0.5, 1e300], [-4.0, 8.0]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r.component for r in rows} <= {1, 2} and any(r.deviation is None for r in rows)


def test_gram_is_exact_at_any_size():
    rng = np.random.default_rng(5)
    for most in (10, 2**20, 2**52):
        y = rng.integers(-most, most, size=(50, 3))
        o = y.astype(object)
        assert (whitening.gram(y) == o.T @ o).all()


def test_factor():
    rng = np.random.default_rng(6)
    for d, r in ((1, 1), (5, 5), (6, 2), (31, 31)):
        a = rng.normal(size=(d, r))
        v = a @ a.T
        low = whitening.cholesky(v)
        assert low.shape[1] == r and np.abs(low @ low.T - v).max() < 1e-12 * d
        values, parts = whitening.jacobi(low)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:r], rtol=1e-10) and np.abs(v @ parts - parts * values).max() < 1e-11
