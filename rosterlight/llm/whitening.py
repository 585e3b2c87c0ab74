"""Whitening of embedding vectors along the eigenvectors of their covariance, found by the cyclic Jacobi method.

The covariance is that of the distinct vectors.  Tasks sum the whole numbers exactly, then the products of the centred
rows, one small triangle a task; the driver turns the d x d matrix by Jacobi rotations until no off-diagonal entry is
larger than rounding makes it beside its two diagonal entries, which keeps small eigenvalues accurate, and broadcasts the
whitening matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, scaled, usable, whole, width

COMPONENTS = 4
NO_VARIANCE = 1e-12  # of the trace: a direction with less is flat, as rounding alone gives as much
EPS = float(np.finfo(np.float64).eps)
_EXACT = pa.decimal128(38, 0)


def jacobi(symmetric: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (as columns) of a symmetric matrix, by falling eigenvalue.

    A sweep visits every pair of indexes row by row and turns their plane so that the entry vanishes.  It ends with a
    sweep without a rotation.
    """
    a, d = np.array(symmetric, np.float64), len(symmetric)
    vectors = np.eye(d)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if off == 0 or abs(off) <= EPS * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, half) / (abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                x, y = a[p].copy(), a[q].copy()
                low, high = c * x - s * y, s * x + c * y
                low[p], low[q] = x[p] - t * off, 0.0
                high[q], high[p] = y[q] + t * off, 0.0
                a[p], a[q] = low, high
                a[:, p], a[:, q] = low, high
                x, y = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors with exact sums, the mean, falling eigenvalues and unit eigenvectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def projection(self, components: int) -> np.ndarray:
        """d x components: projects a centred vector and scales it; NaN columns for components without variance."""
        e = self.values[:components]
        flat = e <= NO_VARIANCE * max(self.values.sum(), 0.0)
        return self.vectors[:, :components] / np.sqrt(np.where(flat, np.nan, e))

    def explained(self, components: int) -> np.ndarray:
        total = self.values.sum()
        return self.values[:components] / total if total > 0 else np.zeros(min(components, len(self.values)))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows ``fit`` (x: array of long) has, and the exact sum of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            n += b.num_rows
            total = [t + s for t, s in zip(total, matrix(b.column(0), d).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], _EXACT), pa.array([n] * d, pa.int64())], ["i", "s", "n"])

    rows = fit.mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows]


def _mean(fit: DataFrame, d: int, shaped: Callable[[np.ndarray], np.ndarray], k: int, n: int) -> np.ndarray:
    """The mean of the ``k`` numbers that ``shaped`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            total += shaped(matrix(b.column(0), d)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["i", "s"])

    return np.array([r["s"] for r in fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]) / n


def _covariance(fit: DataFrame, d: int, shaped: Callable[[np.ndarray], np.ndarray], k: int, n: int) -> np.ndarray:
    """The second moments, over ``fit``, of the ``k`` centred numbers that ``shaped`` makes of each row; divisor ``n``."""
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            y = shaped(matrix(b.column(0), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((k, k))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def fitted(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of the distinct vectors, and its identity error: the largest absolute entry of the covariance of the
    whitened distinct vectors, over the components with variance, minus the identity.

    Null and empty vectors and those with null or non-finite entries are left out.  Without any vector there is no
    whitening; without a component with variance there is no error.  Only matrices of d x d reach the driver.
    """
    rows = usable(vectors, vector_col)
    fit = stored(rows.select(scaled(vector_col).alias("x")).distinct(), "distinct-vectors")
    d = width(fit, "x")
    if not d:
        return None, None
    n, sums = _sums(fit, d)
    mean = np.array([s / n for s in sums])
    values, axes = jacobi(_covariance(fit, d, lambda x: x - mean, d, n))
    found = Whitening(n, tuple(sums), values, axes)
    turn = found.projection(components)
    turn = turn[:, ~np.isnan(turn[0])]
    k = turn.shape[1]
    if not k:
        return found, None
    middle = _mean(fit, d, lambda x: (x - mean) @ turn, k, n)
    return found, float(np.abs(_covariance(fit, d, lambda x: (x - mean) @ turn - middle, k, n) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[Decimal]:
    """Per row the exact sum of (n x - S)^2, from sums of whole numbers: n^2 sum(x^2) - 2 n sum(x S) + sum(S^2)."""
    most = int(np.abs(x).max(initial=0))
    if most * most * x.shape[1] >= 1 << 62:
        x = x.astype(object)
    squares = (x * x).sum(1).tolist()
    reach = most * sum(map(abs, sums))
    s = np.array(sums, np.int64 if reach < 1 << 62 and max(map(abs, sums)) < 1 << 62 else object)
    products = (x * s).sum(1).tolist()
    both = sum(t * t for t in sums)
    return [Decimal(n * n * a - 2 * n * b + both) for a, b in zip(squares, products, strict=True)]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component up to ``components``: id, component, n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over entries of (n x - S)^2 as decimal(38,0).  A component without variance (at most
    10^-12 of the trace) has a null ``whitened``.  Repeated vectors count once in the fit and keep a row each, with the
    same values; a null id stays null; vectors with fewer entries than components have fewer rows; an empty table gives
    an empty result; other columns play no part.  Vectors of several lengths, and entries that reach 2^28 times 1/256,
    are an error.
    """
    rows = usable(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model, error = fitted(vectors, vector_col, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean, model.projection(components), model.explained(components), error))
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, turn, explained, error = shared.value
        k = turn.shape[1]
        for b in batches:
            x = whole(b.column(1), d)
            rows = np.repeat(np.arange(len(x)), k)
            parts = ((x - mean) @ turn).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), n), pa.int64()),
                    pa.array(_deviations(x, n, sums), _EXACT).take(pa.array(rows)),
                    pa.array(parts, pa.float64(), mask=np.isnan(parts)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array([error] * len(rows), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whitened`` with deviation as long; null where it is beyond a long (from some 10^8 distinct vectors on)."""
    return whitened(vectors, id_col, vector_col, components).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
