"""Whitening of embeddings by their principal components.

Entries become whole numbers on a grid, and each different vector counts once. Three passes over these: counts and sums (whole numbers,
exact), the scatter of the centred vectors (a matrix per task, summed entry by entry), and the covariance of the outcome as a check. The
driver has one matrix of d x d numbers, whatever the number of vectors, and turns it by cyclic Jacobi rotations until nothing is left off
its diagonal; the matrix that whitens, again d x d, goes to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh_names, python_workers, stored

#: Steps of the grid in a unit, and components that come out.
GRID, COMPONENTS = 256, 4
#: An entry off the diagonal is nothing below this share of the two variances it joins, or of the largest one; sweeps there are at most.
PRECISION, TINY, SWEEPS = 2.0**-53, 1e-30, 60
#: Eigenvalues below this share of the largest, for each dimension, are noise of a direction in which nothing varies.
NOISE = 1e-14
WHOLE = 1 << 63


def on_grid(vector: Column, grid: int = GRID) -> Column:
    """array<bigint>: the entries times ``grid``, rounded down; null for a vector that is null, empty or has a null, NaN or infinite entry."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.when(F.forall(vector, fine) & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(F.lit(float(grid)) * c.cast("double"))))


def rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a batch as the rows of a matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(j, high, low): sums of the entries by dimension, their upper and lower 32 bits apart so that none overflows."""
    high = low = None
    for batch in batches:
        if len(batch):
            x = rows_of(batch, "x")
            h, lo = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            high, low = (h, lo) if high is None else (high + h, low + lo)
    if high is not None:
        yield pa.RecordBatch.from_pydict({"j": np.arange(len(high), dtype=np.int32), "high": high, "low": low})


def scatter(batches: Iterator[pa.RecordBatch], moved: np.ndarray, by: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(i, j, v), i <= j: the task's part of the sum of outer products of (x - moved), times ``by`` if given."""
    total = None
    for batch in batches:
        if len(batch):
            y = rows_of(batch, "x") - moved
            y = y if by is None else y @ by
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})


def scattered(fit: DataFrame, d: int, moved: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """The scatter over all of ``fit``: tasks' matrices are summed entry by entry in a shuffle, so the driver gets d x d numbers."""
    parts = fit.mapInArrow(lambda batches: scatter(batches, moved, by), "i int, j int, v double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by cyclic Jacobi rotations.

    Sweep by sweep, each entry off the diagonal is turned to zero by a rotation of its two dimensions, unless it is below the precision of
    the geometric mean of their variances already; a sweep without rotations is the last. Held against these two variances and not against
    the largest one, small eigenvalues of a positive matrix keep their digits.
    """
    a, n = np.array(matrix, dtype=float), len(matrix)
    turned, least = np.eye(n), TINY * float(np.abs(np.diag(matrix)).max(initial=0.0))
    for _ in range(SWEEPS):
        rotations = 0
        for p in range(n - 1):
            for q in range(p + 1, n):
                x, y, off = a[p, p], a[q, q], a[p, q]
                if abs(off) <= max(PRECISION * math.sqrt(abs(x * y)), least):
                    continue
                rotations += 1
                theta = (y - x) / (2.0 * off)
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1.0 / math.hypot(t, 1.0)
                turn, two = np.array([[c, t * c], [-t * c, c]]), [p, q]
                a[:, two] = a[:, two] @ turn
                a[two, :] = turn.T @ a[two, :]
                a[p, p], a[q, q], a[p, q], a[q, p] = x - t * off, y + t * off, 0.0, 0.0
                turned[:, two] = turned[:, two] @ turn
        if not rotations:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


@dataclass(frozen=True)
class Whitening:
    """n different vectors of d entries with the sums ``sums`` of each; ``values`` and ``vectors`` of their covariance, without those of
    noise; ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def matrix(self, k: int) -> np.ndarray:
        """d x k: times a centred vector, the values of its first k components, each of variance one."""
        k = min(k, len(self.values))
        return self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of a ``stored`` table (x array<bigint>) of different vectors of one length; None if there is no vector."""
    sums = vectors.mapInArrow(_sums, "j int, high bigint, low bigint").groupBy("j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    n, d = vectors.count(), len(sums)
    if not n:
        return None
    whole = [0] * d
    for r in sums:
        whole[r.j] = (int(r.high) << 32) + int(r.low)
    covariance = scattered(vectors, d, np.array([s / n for s in whole])) / n
    values, turned = jacobi(covariance)
    real = values > NOISE * d * max(float(values[0]), 0.0)
    return Whitening(n, tuple(whole), values[real], turned[:, real], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the covariance of the first k whitened components, less the identity, over the different vectors."""
    by = model.matrix(k)
    found = scattered(vectors, by.shape[1], model.mean, by) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n*x - S)**2 over the dimensions, exactly; None where that is no 64-bit number."""
    bound = max(n * int(np.abs(x).max(initial=0)), 1) if (x > -WHOLE).all() else n * WHOLE
    bound = (bound + max(map(abs, sums))) ** 2 * x.shape[1]
    if bound < WHOLE:
        apart = n * x - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < WHOLE else None for v in found]


def whiten(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """A row per row with a sound vector and component up to k: (id_col, component, n, deviation, whitened, explained, identity_error).

    Rows without a sound vector (null, empty, null or non-finite entries) are left out, and so are vectors of another length than the most
    common one (of equally common ones, the longest). Entries beyond 2**63 / grid stand for the largest number; a deviation that is no 64-bit
    number is null. Null and repeated ids are rows like others, equal vectors get equal values. Directions without variance are no
    components, so one vector alone, or copies of one, give no rows, as does an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    python_workers(spark)
    named, = fresh_names(docs, 1)
    rows = docs.select(F.col(id_col).alias(id_col), on_grid(F.col(vec_col), grid).alias(named)).where(F.col(named).isNotNull())
    lengths = rows.groupBy(F.size(named).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = f"id {dict(docs.dtypes)[id_col]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.where(F.size(named) == lengths[0].d)
    different = stored(rows.select(F.col(named).alias("x")).distinct())
    model = fit(different)
    explained = (model.values / model.trace).tolist()
    components = min(k, len(explained))
    if not components:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, mean, by, n, sums = identity_error(different, model, components), model.mean, model.matrix(components), model.n, model.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.array(range(1, components + 1), pa.int32())
        for batch in batches:
            rows = len(batch)
            if rows:
                x = rows_of(batch, "x")
                # A sum per entry in a fixed order: equal vectors have equal values in whatever batch they are.
                whitened = np.stack([((x - mean) * by[:, c]).sum(1) for c in range(components)], axis=1)
                each = pa.array(np.repeat(np.arange(rows), components))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(each), pa.concat_arrays([number] * rows), pa.array([n] * (rows * components), pa.int64()),
                        pa.array(deviations(x, n, sums), pa.int64()).take(each), pa.array(whitened.ravel()), pa.array(explained[:components] * rows), pa.array([error] * (rows * components)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col(id_col).alias("id"), F.col(named).alias("x")).mapInArrow(project, schema).withColumnRenamed("id", id_col)
