"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers x = floor(1024 * c) + 100000, so sums and scatter are
exact and don't depend on how rows are dealt to tasks. A first pass adds up x;
a second one centres each vector on the rounded means before it is multiplied
(what rounding the means leaves is corrected in integers too); Spark adds the
tasks' cells. The driver only gets matrices of the vectors' length: it divides
the exact scatter into the covariance V, factors V = L L' with diagonal
pivoting, and rotates pairs of L's columns until all are orthogonal. Then V =
(L W)(L W)', so squared column norms are the eigenvalues and normalised columns
the components; V's eigenproblem itself is never formed. A third pass measures
how far the covariance of the whitened rows is from the identity.

Edge cases: vectors that are null or empty, or hold null or non-finite entries,
are left out, and so are those of another length than the commonest (of equally
common ones the longest); a null vec_id is kept, repeated rows and ties count
one by one; entries beyond 2^42 count as 2^42; ``deviation`` is null where it
doesn't fit a long; eigenvalues that rounding can't tell from 0 give no
component, so equal or single vectors, like an empty table, give no rows; very
long vectors cost the driver their squared length; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Components that are returned.
MOST = 8
#: Scaled entries are clipped to this magnitude, from which a double's floor says little.
CLIP = float(2**52)
ROWS = 8192
EPS = np.finfo(np.float64).eps
SWEEPS = 60
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Exact count and sums of the fit list, its trace, and eigenvalues (falling) with unit components in columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def mean(self) -> list[int]:
        return [round(Fraction(s, self.n)) for s in self.sums]

    @property
    def left(self) -> list[int]:
        """n times what the rounded means leave."""
        return [s - self.n * m for s, m in zip(self.sums, self.mean)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = own.filter(F.coalesce(fine, F.lit(False)))
    common = own.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return own.filter(F.size("v") == (common["size"] if common else 0))


def _integers(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as rows of integers."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        v = part.column(part.schema.get_field_index("v"))
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        with np.errstate(over="ignore"):
            yield part, np.clip(np.floor(SCALE * x), -CLIP, CLIP).astype(np.int64) + SHIFT


def gram(y: np.ndarray) -> np.ndarray:
    """y' y in Python integers; by doubles as long as every partial sum is exact in them."""
    if not len(y):
        return np.zeros((y.shape[1],) * 2, dtype=object)
    most = int(np.abs(y).max())
    if most * most * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(y) > 1:
        return gram(y[: len(y) // 2]) + gram(y[len(y) // 2 :])
    o = y[0].astype(object)
    return np.multiply.outer(o, o)


def _cells(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["cell", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for _, x in _integers(batch):
            # Two halves, so that the sum of a slice can't pass a long.
            own = (x >> 26).sum(axis=0).astype(object) * 2**26 + (x & (2**26 - 1)).sum(axis=0).astype(object)
            own = np.append(own, len(x))
            total = own if total is None else total + own
    if total is not None:
        yield _cells(total.tolist())


def _scatter(mean: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.array(mean, dtype=np.int64)
        total = None
        for batch in batches:
            for _, x in _integers(batch):
                own = gram(x - m)
                total = own if total is None else total + own
        if total is not None:
            yield _cells(total[np.triu_indices(len(mean))].tolist())

    return run


def _added(rows: DataFrame) -> list[int]:
    """Sums by cell, in order; as many rows as the tasks' matrices have cells."""
    return [int(r.value) for r in rows.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()]


def cholesky(v: np.ndarray) -> np.ndarray:
    """L of full column rank with L L' = v (rows in the order of v), by diagonal pivoting."""
    a = v.copy()
    d = len(a)
    least = d * EPS * max(a.diagonal().max(initial=0.0), 0.0)
    columns = []
    open_ = np.ones(d, dtype=bool)
    while open_.any():
        k = int(np.argmax(np.where(open_, a.diagonal(), -np.inf)))
        if not a[k, k] > least:
            break
        column = np.where(open_, a[:, k], 0.0) / np.sqrt(a[k, k])
        columns.append(column)
        open_[k] = False
        a -= np.outer(column, column)
    return np.array(columns).T.reshape(d, -1)


def jacobi(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of low low'. A sweep rotates every pair of columns once, disjoint pairs at a time."""
    d, r = low.shape
    a = np.zeros((d, r + r % 2))
    a[:, :r] = low
    seats = np.arange(a.shape[1])
    enough = EPS * max(4.0, np.sqrt(d))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            do = np.abs(xy) > enough * np.sqrt(xx) * np.sqrt(yy)
            if do.any():
                turned = True
                z = np.where(do, yy - xx, 1.0) / (2 * np.where(do, xy, 1.0))
                t = np.where(do, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > np.sqrt(d * EPS) * norms.max(initial=0.0)]
    return norms[order] ** 2, a[:, order] / norms[order]


def fit(own: DataFrame) -> Whitening | None:
    """``own`` (vec_id, v) as from ``usable``; None without rows."""
    sums = _added(own.select("v").mapInArrow(_sums, "cell long, value decimal(38,0)"))
    if not sums:
        return None
    n = sums.pop()
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    left = model.left
    cells = _added(own.select("v").mapInArrow(_scatter(model.mean), "cell long, value decimal(38,0)"))
    d = len(sums)
    v = np.zeros((d, d))
    for i, j, cell in zip(*np.triu_indices(d), cells):
        # Exact until the one division.
        v[i, j] = v[j, i] = (n * cell - left[i] * left[j]) / (n * n)
    model.trace = float(np.trace(v))
    model.values, model.components = jacobi(cholesky(v))
    return model


def _deviation(y: np.ndarray, n: int, left: list[int]) -> list[int | None]:
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, left))
    if most * most * y.shape[1] < 2**63:
        return ((n * y - np.array(left, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    o = n * y.astype(object) - np.array(left, dtype=object)
    return [s if s < 2**63 else None for s in (o * o).sum(axis=1)]


def _project(model: Whitening, most: int):
    """z = (x - S / n) on the components, over the root of the eigenvalues."""
    mean, rest = np.array(model.mean, dtype=np.int64), np.array([x / model.n for x in model.left])
    basis = model.components[:, :most] / np.sqrt(model.values[:most])

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - mean
        return y, (y - rest) @ basis

    return run


def _moments(model: Whitening, most: int):
    project = _project(model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(most, len(model.values))
        total = np.zeros(k + k * k)
        for batch in batches:
            for _, x in _integers(batch):
                _, z = project(x)
                total += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["cell", "value"])

    return run


def identity_error(own: DataFrame, model: Whitening, most: int = MOST) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = min(most, len(model.values))
    cells = own.select("v").mapInArrow(_moments(model, most), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
    total = np.array([r.value for r in cells]) / model.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _rows(model: Whitening, error: float, most: int):
    project = _project(model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(most, len(model.values))
        explained = model.values[:k] / model.trace
        for batch in batches:
            for part, x in _integers(batch):
                y, z = project(x)
                rows = len(x)
                each = np.repeat(np.arange(rows), k)
                ids, deviation = part.column(part.schema.get_field_index("vec_id")), pa.array(_deviation(y, model.n, model.left), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        deviation.take(pa.array(each)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, *, most: int = MOST) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) -> a row for each vector and component up to ``most``."""
    own = usable(vectors)
    model = fit(own)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    return own.mapInArrow(_rows(model, identity_error(own, model, most), most), RESULT)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
