"""Embedding whitening: float32 eigenvectors of the covariance, refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.frames import small_batches
from footfall.llm.vectors import integers, pieces, whole_vectors, widest

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Vectors worked on at a time, and the largest integer of a component: products of so many stay exact.
ROWS = 2_048
LIMIT = 2**20
# Refinement ends after so many rounds that did not halve the smallest error so far: rounding is all that is left.
PATIENCE = 3

_Wide = np.longdouble


@dataclass
class Whitening:
    """``count`` and ``sums`` of the fit list, eigenvectors as columns by falling eigenvalue, and the trace."""

    count: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def near_mean(self) -> np.ndarray:
        """The mean, rounded down: integers close to it keep differences small and exact."""
        return self.sums // max(1, self.count)

    def project(self, own: np.ndarray) -> np.ndarray:
        """Integer rows less their mean, projected on the components, over the roots of the eigenvalues.

        NaN for components without variance.
        """
        rest = (self.sums - self.count * self.near_mean) / max(1, self.count)
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((own - self.near_mean) - rest) @ self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sums of their components."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in pieces(batches, ROWS):
            total[:width] += _integers(batch.column("vector"), width).sum(axis=0)
            total[width] += batch.num_rows
        yield _cells(total)

    found = _added(rows, summed, width + 1)
    return int(found[width]), np.array(found[:width], np.int64)


def products(rows: DataFrame, width: int, near_mean: np.ndarray) -> np.ndarray:
    """The exact sums of products of components (as Python integers), each less its entry of ``near_mean``."""
    shared = rows.sparkSession.sparkContext.broadcast(near_mean)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((width, width), np.int64), 0
        for batch in pieces(batches, ROWS):
            own = (_integers(batch.column("vector"), width) - shared.value).astype(np.float64)
            largest = batch.num_rows * float(np.abs(own).max(initial=0)) ** 2
            if held + largest > 2.0**62:
                yield _cells(total.ravel())
                total, held = np.zeros_like(total), 0
            total += (own.T @ own).astype(np.int64)  # below 2**53, so exact
            held += largest
        yield _cells(total.ravel())

    return _added(rows, summed, width * width).reshape(width, width)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return integers(column, width, SCALE, LIMIT) + SHIFT


def _cells(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.record_batch([pa.array(some), pa.array(total[some])], names=["cell", "total"])


def _added(rows: DataFrame, summed, size: int) -> np.ndarray:
    """The tasks' totals, added up by cell; the driver receives one number a cell."""
    cells = rows.select("vector").mapInArrow(summed, "cell long, total long")
    table = cells.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toArrow()
    out = np.full(size, 0, object)
    for cell, total in zip(table.column("cell").to_pylist(), table.column("total").to_pylist()):
        out[cell] = int(total)
    return out


def covariance(count: int, sums: np.ndarray, centred: np.ndarray) -> np.ndarray:
    """From sums of products around the rounded mean: the part of the mean below one is taken off exactly."""
    rest = np.array([int(s) % count for s in sums], object)
    exact = centred * count - np.outer(rest, rest)  # n * n times the covariance, in integers
    return _wide(exact) / _Wide(count) / _Wide(count)


def _wide(exact: np.ndarray) -> np.ndarray:
    """Integers in extended precision; those beyond 2**62 in two parts."""
    out = np.zeros(exact.shape, _Wide)
    for at, value in np.ndenumerate(exact):
        high, low = divmod(int(value), 1 << 62)
        high, middle = divmod(high, 1 << 62)
        out[at] = (_Wide(high) * _Wide(2.0**62) + _Wide(middle)) * _Wide(2.0**62) + _Wide(low)
    return out


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    The start is a float32 decomposition. Each round then corrects all vectors at once by matrix products in
    extended precision: with ``R = I - X'X`` and ``S = X'AX``, the correction of pairs of distinct
    eigenvalues is ``(S + value * R) / gap``, that of pairs closer than the error of the round ``R / 2``;
    the error falls quadratically. Vectors of such close eigenvalues span the right space but are mixed
    within it, so each cluster gets a decomposition of its own, of the small matrix less the cluster's mean
    eigenvalue, which resolves gaps that the whole matrix hides; later rounds refine what it gave. Equal
    eigenvalues keep some orthonormal basis. The largest component of each vector is positive.
    """
    size = len(matrix)
    norm = np.abs(matrix).sum(axis=1).max(initial=0)
    if not norm:
        return np.zeros(size), np.eye(size)
    matrix = matrix / norm
    vectors = np.linalg.eigh(matrix.astype(np.float32))[1].astype(_Wide)
    best, held, late = np.inf, vectors, 0
    while late < PATIENCE:
        lost = np.eye(size, dtype=_Wide) - vectors.T @ vectors
        inner = vectors.T @ matrix @ vectors
        lost, inner = (lost + lost.T) / 2, (inner + inner.T) / 2  # else rounding, over a small gap, spoils orthogonality
        values = np.diag(inner) / (1 - np.diag(lost))
        order = np.argsort(values, kind="stable")
        vectors, values, lost, inner = vectors[:, order], values[order], lost[np.ix_(order, order)], inner[np.ix_(order, order)]
        error = 2 * (_norm(inner - np.diag(values)) + _norm(lost))
        late = 0 if error < best / 2 else late + 1
        if error < best:
            best, held = error, vectors
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= error
        change = np.where(close, lost / 2, (inner + values[None, :] * lost) / np.where(close, 1, gap))
        vectors = vectors + vectors @ change
        clusters = [c for c in np.split(np.arange(size), np.flatnonzero(np.diff(values) > error) + 1) if len(c) > 1]
        for cluster in clusters:
            vectors[:, cluster] = _resolved(matrix, vectors[:, cluster], values[cluster].mean())
    values = np.diag(held.T @ matrix @ held) / (held * held).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = held[:, order] / np.sqrt((held[:, order] ** 2).sum(axis=0))
    vectors *= np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0))
    return (values[order] * norm).astype(np.float64), vectors.astype(np.float64)


def _norm(matrix: np.ndarray) -> np.floating:
    return np.sqrt((matrix * matrix).sum())


def _resolved(matrix: np.ndarray, vectors: np.ndarray, middle: np.floating) -> np.ndarray:
    """The vectors of one cluster, turned to the eigenvectors of the matrix within their span."""
    small = vectors.T @ (matrix @ vectors - middle * vectors)
    largest = np.abs(small).max()
    if not largest:
        return vectors
    small = ((small + small.T) / (2 * largest)).astype(np.float64)
    return vectors @ np.linalg.eigh(small)[1].astype(_Wide)


def fit(rows: DataFrame, width: int, components: int) -> Whitening:
    """Learn from all rows, in two passes: sums first, then products of what is centred by them."""
    count, sums = moments(rows, width)
    if not count:
        return Whitening(0, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0), 0.0)
    spread = covariance(count, sums, products(rows, width, sums // count))
    values, vectors = eigenvectors(spread)
    trace = float(np.trace(spread))
    values = np.where(values > trace * width * np.finfo(np.float64).eps, values, 0)
    return Whitening(count, sums, vectors[:, :components], values[:components], trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the whitened rows' covariance is from the identity: the largest entry, measured over all rows.

    Components without variance are not counted; 0 if there are no others.
    """
    some = np.flatnonzero(model.values > 0)
    width, size = len(model.sums), len(some)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for batch in pieces(batches, ROWS):
            own = shared.value.project(_integers(batch.column("vector"), width))[:, some]
            total += np.concatenate([own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "total"])

    if not size:
        return 0.0
    cells = rows.select("vector").mapInArrow(summed, "cell long, total double")
    found = dict(cells.groupBy("cell").agg(F.sum("total")).collect())
    total = np.array([found[i] for i in range(size + size * size)]) / model.count
    mean, second = total[:size], total[size:].reshape(size, size)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each whole vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries are taken as ``floor(SCALE * x) + SHIFT``. All whole vectors are fitted on; those that are NULL or
    hold NULL or non-finite entries are left out, and shorter ones count as filled up with zeros. Components
    are numbered from 1 by falling eigenvalue of the covariance; there are as many as the longest vector has
    entries, ``components`` at most. ``deviation`` is exact (a decimal: it may pass a long's range), ``explained``
    the eigenvalue's share of the trace. A component without variance (a single or repeated vector, for
    instance) has a NULL ``whitened``, and ``explained`` is 0 where the trace is. Repeated rows each count and
    each have a result; without vectors the result is empty. Entries above ``LIMIT / SCALE`` raise an error.

    All sums are integers and exact, whatever the order of the tasks. The driver receives the squared number of
    dimensions, as the eigenvectors need it, and the tasks the eigenvectors.
    """
    small_batches(vectors.sparkSession)
    rows = whole_vectors(vectors, vector_col, vec_id=id_col)
    width = widest(rows)
    model = fit(rows, width, components)
    error = identity_error(rows, model)
    size = len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(size)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField("vec_id", vectors.schema[id_col].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS) if size else ():
            own = _integers(batch.column("vector"), width)
            white = shared.value.project(own).ravel()
            count = batch.num_rows
            each = np.repeat(np.arange(count), size)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                pa.array(np.full(count * size, model.count)),
                _deviations(own, shared.value).take(pa.array(each)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(explained, count)),
                pa.array(np.full(count * size, error)),
            ]
            yield pa.record_batch(columns, names=schema.names)

    return rows.mapInArrow(projected, schema)


def _deviations(own: np.ndarray, model: Whitening) -> pa.Array:
    """The sum over all dimensions of (n * x - S)**2 of each row, in integers."""
    near, rest = own - model.near_mean, model.sums - model.count * model.near_mean
    largest = model.count * (int(np.abs(near).max(initial=0)) + 1)
    if largest**2 * own.shape[1] >= 2**63:
        near, rest = near.astype(object), rest.astype(object)
    total = ((model.count * near - rest) ** 2).sum(axis=1)
    from decimal import Decimal

    return pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
