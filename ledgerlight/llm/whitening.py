"""Whitening of embeddings with a covariance by polarisation.

Entries become whole numbers, so every sum is exact. A first pass adds up each dimension. A second one adds up squares of
centred values, ``y_i ** 2`` for each dimension and ``(y_i + y_j) ** 2`` for each pair of dimensions; as
``Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b)``, half the differences of these variances are the cross-covariances. Values
are centred by the whole part of the mean, and the rest of the mean is taken off the sums, exactly. Only these sums, one
for each dimension and pair, reach the driver, where ``eigh`` finds the components; all rows are then projected, and a
third pass measures the covariance of what came out.

Sums leave a task as limbs of 48 bits, so they are exact at any number of rows and any size of entries. Where squares of
a batch could pass 63 bits they are added up as Python's integers.

Defined results: rows whose vector is null or empty or holds null, non-finite or too large entries (2**52 or more, whose
products don't fit a long) take no part; if vectors differ in length, those of the commonest length do (of equally common
ones the longer); repeated rows and ids count as often as they occur, and a null id stays null. A component whose
eigenvalue is nothing but rounding (constant or dependent dimensions) can't be scaled to variance one and is left out, so
a table of equal vectors, one vector or none gives no rows. ``deviation`` is null beyond the range of a long. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on are left out.
TOO_LARGE = 2.0**52
LIMB = 48
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    center: np.ndarray  # whole part of the mean of each dimension
    rest: list[int]  # n times what the mean is above it
    covariance: np.ndarray
    axes: np.ndarray  # one column for each component, unit length
    values: np.ndarray  # their eigenvalues, falling

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows given as differences from ``center``."""
        return (y - np.array([r / self.n for r in self.rest])) @ self.scaled


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce((c > -TOO_LARGE) & (c < TOO_LARGE), F.lit(False))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def whole(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares: one for each dimension, then for the sum of each pair, in order."""
    d = y.shape[1]
    largest = 2 * max(int(y.max()), -int(y.min())) + 1
    if largest * largest * len(y) >= 1 << 63:
        y = y.astype(object)
    out = (y * y).sum(axis=0).tolist()
    columns = np.ascontiguousarray(y.T)
    for i in range(d - 1):
        pairs = columns[i + 1 :] + columns[i]
        out += (pairs * pairs).sum(axis=1).tolist()
    return out


def sums(rows: DataFrame, of: Callable[[np.ndarray], list[int]]) -> list[int]:
    """Exact sums of what ``of`` gives for the rows of each batch; the first is the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                x = whole(b.column(0).slice(start, 4096))
                found = [len(x), *of(x)]
                total = [a + c for a, c in zip(total, found, strict=True)] if total else found
        if total:
            limbs = [[(v >> (LIMB * k)) & ((1 << LIMB) - 1) if k < 3 else v >> (LIMB * 3) for v in total] for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["slot", "a", "b", "c", "d"])

    parts = arrow_map(rows.select("v"), run, "slot int, a long, b long, c long, d long")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "abcd"]
    found = {r["slot"]: sum(int(r[c]) << (LIMB * k) for k, c in enumerate("abcd")) for r in parts.groupBy("slot").agg(*wide).collect()}
    return [found[i] for i in range(len(found))]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of ``usable`` rows, or None if there are none. ``components`` is how many at most."""
    found = sums(rows, lambda x: [sum(c.tolist()) for c in x.T])
    if not found:
        return None
    n, totals = found[0], found[1:]
    d, center = len(totals), [s // n for s in totals]
    rest = [s - n * c for s, c in zip(totals, center, strict=True)]
    middle = np.array(center, np.int64)
    q = sums(rows, lambda x: squares(x - middle))[1:]
    # n times the sum of squares about the mean: variances, times n * n
    spread = [n * a - r * r for a, r in zip(q, rest, strict=False)]
    covariance, at = np.empty((d, d)), d
    for i in range(d):
        covariance[i, i] = spread[i] / (n * n)
        for j in range(i + 1, d):
            both = n * q[at] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - spread[i] - spread[j]) // 2 / (n * n)
            at += 1
    values, axes = np.linalg.eigh(covariance)
    order = [k for k in range(d - 1, -1, -1) if values[k] > d * np.finfo(float).eps * values[-1]][:components]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, middle, rest, covariance, axes, values[order])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest difference of the covariance of whitened rows from the identity, measured over all rows."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            if not b.num_rows:
                continue
            w = model.project(whole(b.column(0)) - model.center)
            total += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total)], ["slot", "s"])

    parts = arrow_map(rows.select("v"), run, "slot int, s double")
    found = {r["slot"]: r["s"] for r in parts.groupBy("slot").agg(F.sum("s").alias("s")).collect()}
    return float(np.abs(np.array([found[i] for i in range(k * k)]).reshape(k, k) / model.n - np.eye(k)).max())


def deviations(y: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2`` for each row, exact."""
    largest = model.n * (max(int(y.max()), -int(y.min())) + 1)
    if largest * largest * y.shape[1] < 1 << 63:
        c = model.n * y - np.array(model.rest, np.int64)
        return (c * c).sum(axis=1).tolist()
    c = model.n * y.astype(object) - np.array(model.rest, object)
    return [v if v < 1 << 63 else None for v in (c * c).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every row that takes part, with what they explain."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], OUT)
    k, explained = len(model.values), model.values / np.trace(model.covariance)
    error = identity_error(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(b.column(1)) - model.center
            m, deviation = len(y), pa.array(deviations(y, model), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    deviation.take(each), pa.array(model.project(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow_map(rows, run, OUT)
