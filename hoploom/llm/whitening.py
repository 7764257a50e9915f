"""Embedding whitening: Welford's updates within partitions, merged by the parallel formula, and a symmetric QR eigen-solve.

A vector's entries c become whole numbers x = floor(64 c) + 1000000. Each distinct
x vector is fitted once. A task streams over its vectors and holds one state
(number, sums of x, mean, sums of products of deviations), updated by a rank-one
term a vector; states are merged within the partitions of one shuffle, and what
comes to the driver is a state for each of these. The covariance, whose size
depends on the dimension alone, is brought to tridiagonal form by reflections and
diagonalised by shifted QR steps.

Sums are exact. Means and products are taken of x - 1000000, so they are of small
numbers whatever the offset.

Defined results: rows whose vector is null or holds null or non-finite entries
have no rows, nor have empty vectors; the fit list has the commonest number of
dimensions (of equally common ones the smaller), and vectors of other numbers of
dimensions have no rows; a component without variance (at most 1e-12 of the
largest) is whitened to 0 and left out of the identity error; a deviation beyond
64 bits is null; entries beyond 2^40 / 64 are taken as that bound; repeated rows
all have rows; null ids stay null; an empty table gives no rows; extra columns
are ignored. An eigenvector's sign makes its largest entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import list_arrays, table

#: Fixed values of the grid.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this many steps are taken as the bound.
BOUND = 1 << 40
STATE = "slot int, n long, sums array<long>, mean array<double>, products array<double>"


@dataclass
class Moments:
    """Number of vectors, their sums, mean and summed products of deviations; means and products are of x - OFFSET."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, dtype=object), np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, a rank-one term a row."""
        mean, products = self.mean, self.products
        for row in rows:
            self.n += 1
            before = row - mean
            mean += before / self.n
            products += before[:, None] * (row - mean)

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def covariance(self) -> np.ndarray:
        v = self.products / max(1, self.n)
        return (v + v.T) / 2


def _state_batch(slot: int, m: Moments):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([slot], pa.int32()), pa.array([m.n], pa.int64()), pa.array([[int(s) for s in m.sums]], pa.list_(pa.int64())), pa.array([m.mean.tolist()]), pa.array([m.products.ravel().tolist()])],
        names=["slot", "n", "sums", "mean", "products"],
    )


def moments(vectors: DataFrame, column: str, d: int, offset: int = OFFSET) -> Moments:
    """Moments of a column of lists of ``d`` numbers each."""

    def fit(batches):
        from pyspark import TaskContext

        held = Moments.empty(d)
        for batch in batches:
            values, _ = list_arrays(batch.column(0))
            rows = values.reshape(-1, d)
            if rows.dtype.kind == "i":
                held.sums = held.sums + rows.sum(axis=0, dtype=np.int64).astype(object)
            held.add(rows.astype(np.float64) - offset)
        if held.n:
            yield _state_batch(TaskContext.get().partitionId(), held)

    def merged(states) -> Moments:
        held = Moments.empty(d)
        for s in sorted(states, key=lambda s: s["slot"]):
            held.merge(Moments(s["n"], np.array(s["sums"], dtype=object), np.array(s["mean"]), np.array(s["products"]).reshape(d, d)))
        return held

    def merge(batches):
        held, slot = Moments.empty(d), None
        for batch in batches:
            for s in batch.to_pylist():  # a state at a time; they come sorted by their slot
                slot = s["slot"] if slot is None else slot
                held.merge(merged([s]))
        if held.n:
            yield _state_batch(slot, held)

    states = vectors.select(column).mapInArrow(fit, STATE).repartition("slot").sortWithinPartitions("slot").mapInArrow(merge, STATE)
    return merged([r.asDict() for r in states.collect()])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, side diagonal, q) of a symmetric matrix, by reflections: q' a q is tridiagonal."""
    a, d = np.array(a, dtype=np.float64), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0.0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    QR steps with Wilkinson's shift on the tridiagonal form, as rotations that chase the bulge down each unreduced block.
    """
    diag, side, q = tridiagonal(a)
    rows, eps = q.T.copy(), np.finfo(np.float64).eps
    high = len(diag) - 1
    left = sweeps * max(1, len(diag))
    while high > 0:
        for k in range(high):
            if abs(side[k]) <= eps * (abs(diag[k]) + abs(diag[k + 1])):
                side[k] = 0.0
        if side[high - 1] == 0.0:
            high -= 1
            continue
        if not left:
            raise RuntimeError("eigenvalues did not settle")
        left -= 1
        low = high - 1
        while low > 0 and side[low - 1] != 0.0:
            low -= 1
        half = (diag[high - 1] - diag[high]) / 2
        b = side[high - 1]
        shift = diag[high] - b * b / (half + np.copysign(np.hypot(half, b), half if half else 1.0))
        x, z = diag[low] - shift, side[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                side[k - 1] = r
            p, t, e = diag[k], diag[k + 1], side[k]
            diag[k] = c * c * p + 2 * c * s * e + s * s * t
            diag[k + 1] = s * s * p - 2 * c * s * e + c * c * t
            side[k] = c * s * (t - p) + (c * c - s * s) * e
            x = side[k]
            if k + 1 < high:
                z = s * side[k + 1]
                side[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-diag, kind="stable")
    return diag[order], rows[order].T


@dataclass
class Whitening:
    """A fitted whitening: number and sums of the fit list, the components (rows) and their eigenvalues, the trace, the identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; 0 where there is no variance."""
        alive = self.alive()
        return np.where(alive[:, None], self.components / np.sqrt(np.where(alive, self.values, 1.0))[:, None], 0.0)

    def alive(self) -> np.ndarray:
        return self.values > 1e-12 * max(self.values.max(initial=0.0), 1e-300)


def on_grid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a finite vector, and it as whole numbers in ``x``."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    step = F.transform(c, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))) + OFFSET)
    return vectors.where(c.isNotNull() & finite & (F.size(c) > 0)).withColumn("x", step)


def fit_whitening(grid: DataFrame, components: int = 16) -> Whitening | None:
    """Fitted to every distinct vector of ``x`` once; None if there is none."""
    fit = cut_lineage(grid.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    d = sizes["d"]
    fit = fit.where(F.size("x") == d)
    m = moments(fit, "x", d)
    v = m.covariance()
    values, vectors = symmetric_qr(v)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    found = Whitening(m.n, [int(s) for s in m.sums], vectors.T[:components].copy(), np.maximum(values[:components], 0.0), float(np.trace(v)))
    # The whitened fit list is measured in a pass of its own.
    again = moments(fit.select("x").mapInArrow(_project(found), "vec array<double>, deviation long"), "vec", len(found.values), 0).covariance()
    alive = found.alive()
    off = np.abs(again - np.eye(len(alive)))[np.ix_(alive, alive)]
    found.identity_error = float(off.max(initial=0.0))
    return found


def _project(fitted: Whitening):
    """From ``x``, the batches' last column, to whitened vectors and deviations; other columns go along."""

    def run(batches):
        import pyarrow as pa

        d = len(fitted.sums)
        base = np.array([round(s / fitted.n) for s in fitted.sums], dtype=np.int64)
        rest = np.array([(s - int(b) * fitted.n) / fitted.n for s, b in zip(fitted.sums, base, strict=True)])
        off = np.array([s - int(b) * fitted.n for s, b in zip(fitted.sums, base, strict=True)], dtype=object)
        scaled = fitted.scaled()
        for batch in batches:
            values, _ = list_arrays(batch.column(batch.num_columns - 1))
            y = values.reshape(-1, d) - base
            white = (y.astype(np.float64) - rest) @ scaled.T
            # n x - S = n (x - base) - (S - n base)
            if len(y) and fitted.n * (float(np.abs(y).max()) + 1) * np.sqrt(d) < 2.0**31:
                exact = ((fitted.n * y - off.astype(np.int64)) ** 2).sum(axis=1)
                deviations = pa.array(exact, pa.int64())
            else:
                each = [sum((fitted.n * int(v) - o) ** 2 for v, o in zip(row, off, strict=True)) for row in y]
                deviations = pa.array([v if v < 1 << 63 else None for v in each], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * scaled.shape[0]), pa.array(white.ravel()))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, lists, deviations], names=[*batch.schema.names[:-1], "vec", "deviation"])

    return run


def whiten(grid: DataFrame, fitted: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, vec, deviation) of every row of ``on_grid`` with the fitted number of dimensions."""
    own = grid.where(F.size("x") == len(fitted.sums)).select(key, "x")
    return own.mapInArrow(_project(fitted), f"`{key}` {dict(grid.dtypes)[key]}, vec array<double>, deviation long")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, and the fit's figures."""
    grid = on_grid(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    fitted = fit_whitening(grid)
    if fitted is None:
        return spark.createDataFrame([], f"vec_id {dict(grid.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / fitted.trace) if fitted.trace else 0.0) for e in fitted.values])
    rows = whiten(grid, fitted).select("vec_id", "deviation", F.posexplode("vec").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )
