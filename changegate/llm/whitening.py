r"""Whitening of embeddings by spectral divide and conquer.

*Fit.*  Count and sums, and then the covariance of the centred vectors, are added up in the tasks over batches and merged in a
tree, so one matrix per task is all that moves.  The driver, which holds one matrix of ``dims * dims`` numbers, splits it:

1. QDWH, the dynamically weighted Halley iteration, gives the orthogonal polar factor ``U`` of the covariance shifted by a
   guess in the middle of its spectrum, from QR factorisations alone.
2. ``(U + 1) / 2`` is the spectral projector onto the eigenvectors above the shift; a QR factorisation of its image gives
   bases of the two invariant subspaces, and the matrix falls into two smaller blocks.
3. Both are split again until blocks are single numbers or multiples of the identity, whose every basis will do.

One step of iterative refinement then brings the eigenvectors to the last digits.

*Apply.*  Mean and the scaled components, ``dims`` times ``components`` numbers, go to the tasks with the function, and each
vector is projected where it is read.  How far the whitened covariance is from the identity is measured by a pass of its own.

Vectors are on an integer grid, ``floor(SCALE * c) + OFFSET``, so count, sums and deviations are exact integers.

Defined results: a vector that is null or holds a null or non-finite component takes no part and gives no row.  A vector shorter
than the longest is read as if zeros followed.  Grid values beyond the range of a long stop at its ends; a deviation that does
not fit a long is null.  A component without variance (equal or fewer vectors than dimensions) has null ``whitened`` values and
takes no part in ``identity_error``, which is null if no component has any; ``explained`` is null if there is no variance at
all.  There are as many components as dimensions, at most ``COMPONENTS``; equal eigenvalues give some basis of their space.
Repeated rows count and are returned each; null ids are kept.  No vectors give no rows; extra columns are not read.  More than
``MAX_DIMS`` dimensions raise an error, since the driver holds a matrix of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegate.llm.common import arrow_map, bounded_batches

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
MAX_DIMS = 4096
MERGE = 256  # matrices that one task of the merging tree adds up
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_SAFE = 1 << 53  # below this, doubles hold integers exactly
_EPS = np.finfo(float).eps

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


# ------------------------------------------------------------------------------------------------------------- spectrum


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = max(1.0 / np.linalg.norm(np.linalg.inv(x + _EPS * np.eye(n)), 1) / np.sqrt(n), _EPS)  # a lower bound of its least singular value
    eye = np.eye(n)
    for _ in range(40):
        # The weights map [low, 1] as near to one as a rational function of this degree can.
        d = np.cbrt(4 * (1 - low**2) / low**4)
        a_k = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, eye]))
        moved = b_k / c_k * x + (a_k - b_k / c_k) / np.sqrt(c_k) * (q[:n] @ q[n:].T)
        moved = (moved + moved.T) / 2
        low = min(1.0, low * (a_k + b_k * low**2) / (1 + c_k * low**2))
        change = np.linalg.norm(moved - x)
        x = moved
        if change <= np.cbrt(4 * _EPS) and 1 - low <= 10 * _EPS or change <= 4 * _EPS * np.sqrt(n):
            break
    return x


def _shifts(a: np.ndarray):
    """Guesses of a value inside the spectrum that splits it: the diagonal's median, the mean, and points between its bounds."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    for parts in (2, 4, 8, 16, 32):
        for k in range(1, parts, 2):
            yield low + (high - low) * k / parts


def _split(a: np.ndarray, small: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two complementary invariant subspaces; None where the matrix is a multiple of the identity."""
    n = len(a)
    centre = np.trace(a) / n
    if np.linalg.norm(a - centre * np.eye(n)) <= small:
        return None
    best = None
    for shift in _shifts(a):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # The columns of largest length of a projector span its image well; one more pass cleans the basis.
        order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")[:rank]
        basis = np.linalg.qr(projector[:, order])[0]
        basis = np.linalg.qr(projector @ basis)[0]
        whole = np.linalg.qr(np.hstack([basis, np.eye(n)]))[0]
        upper, lower = whole[:, :rank], whole[:, rank:]
        left_over = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left_over < best[0]:
            best = left_over, upper, lower
        if left_over <= small:
            break
    return None if best is None else best[1:]


def _divide(a: np.ndarray, small: float) -> np.ndarray:
    if len(a) == 1:
        return np.eye(1)
    halves = _split(a, small)
    if halves is None:
        return np.eye(len(a))
    return np.hstack([h @ _divide(_symmetric(h.T @ a @ h), small) for h in halves])


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _refine(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of iterative refinement of all eigenvectors: corrects orthogonality, and directions whose eigenvalues differ."""
    error = np.eye(len(a)) - x.T @ x
    s = _symmetric(x.T @ a @ x)
    values = np.diag(s) / (1 - np.diag(error))
    gap = values[None, :] - values[:, None]
    limit = 2 * (np.linalg.norm(s - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(error))
    apart = np.abs(gap) > limit
    change = np.where(apart, (s + values[None, :] * error) / np.where(apart, gap, 1), error / 2)
    # The step holds to first order, so directions that it would turn far, being nearly equal in value, stay as they are.
    return x + x @ np.where(np.abs(change) < 1e-4, change, error / 2)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, in columns, of a symmetric matrix."""
    a = _symmetric(np.asarray(a, dtype=float))
    if not a.any():
        return np.zeros(len(a)), np.eye(len(a))
    x = _divide(a, 4 * _EPS * np.linalg.norm(a))
    around = a - np.trace(a) / len(a) * np.eye(len(a))  # the same eigenvectors, with less rounding where all values are near
    for _ in range(2):
        x = _refine(around, x)
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2  # orthogonal again, by the nearest orthogonal matrix to first order
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


# ---------------------------------------------------------------------------------------------------------------- Spark


def _grid(column: pa.Array, dims: int) -> np.ndarray:
    """The grid values of a batch of vectors without nulls, one row each."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * out)
    if np.abs(scaled).max(initial=0) < _SAFE:
        return scaled.astype(np.int64) + OFFSET
    exact = [[min(max(int(v) + OFFSET, _LEAST), _MOST) if np.isfinite(v) else (_MOST if v > 0 else _LEAST) for v in row] for row in scaled]
    return np.array(exact, dtype=object)


def _total(grid: np.ndarray) -> list[int]:
    """Exact sums by dimension."""
    if grid.dtype != object and np.abs(grid).max(initial=0) * max(len(grid), 1) < _MOST:
        return [int(v) for v in grid.sum(axis=0)]
    return [sum(map(int, c)) for c in grid.T]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) without nulls and without vectors that hold a null, infinite or undefined component."""
    narrow = vectors.selectExpr(f"cast(`{id_col}` as bigint) as vec_id", f"cast(`{vector_col}` as array<double>) as vector")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return narrow.filter(F.col("vector").isNotNull() & finite)


def count_and_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension; one row per task and dimension moves."""

    def add(batches):
        n, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                sums = [a + b for a, b in zip(sums, _total(_grid(batch.column(0), dims)), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(s) for s in sums])], ["dim", "s"])

    bounded_batches(rows.sparkSession)
    partial = rows.select("vector").mapInArrow(add, "dim int, s string")
    sums = {r["dim"]: int(r["s"]) for r in partial.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return rows.count(), [sums.get(d, 0) for d in range(dims)]


def second_moments(rows: DataFrame, size: int, centred) -> np.ndarray:
    """The sum of outer products of ``centred(batch)``, a matrix of ``size`` columns, over all rows.

    Every task adds up one matrix; a tree of tasks merges ``MERGE`` at a time, down to the one that the driver gets.
    """
    schema = "matrix binary"

    def emit(matrix):
        return pa.RecordBatch.from_arrays([pa.array([matrix.tobytes()], pa.binary())], ["matrix"])

    def add(batches):
        matrix = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = centred(batch)
                matrix += x.T @ x
        yield emit(matrix)

    def merge(batches):
        matrix = np.zeros(size * size)
        for batch in batches:
            for packed in batch.column(0):
                matrix += np.frombuffer(packed.as_py())
        yield emit(matrix)

    bounded_batches(rows.sparkSession)
    partial, tasks = rows.select("vector").mapInArrow(add, schema), None
    while tasks != 1:
        tasks = -(-(tasks or _partitions(rows)) // MERGE)
        partial = partial.repartition(tasks).mapInArrow(merge, schema)
    return np.sum([np.frombuffer(r["matrix"]) for r in partial.collect()], axis=0).reshape(size, size)


def _partitions(rows: DataFrame) -> int:
    """How many tasks read the rows, at least one."""
    return max(1, rows.rdd.getNumPartitions())


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: count, exact sums, mean, scaled components in columns, shares of the variance."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: list[float | None]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def centre(self, column: pa.Array) -> np.ndarray:
        grid = _grid(column, len(self.sums))
        if grid.dtype == object:
            return np.array([[(self.n * int(v) - s) / self.n for v, s in zip(row, self.sums, strict=True)] for row in grid])
        return grid - self.mean

    def whiten(self, column: pa.Array) -> np.ndarray:
        """One row per vector, one column per component; a component without variance is NaN."""
        return self.centre(column) @ self.scaled

    def deviations(self, column: pa.Array) -> list[int | None]:
        grid = _grid(column, len(self.sums))
        if grid.dtype != object:
            sums, top = np.array(self.sums, dtype=object), int(np.abs(grid).max(initial=0))
            bound = self.n * top + max(map(abs, self.sums), default=0)
            if bound * bound * max(len(self.sums), 1) <= _MOST:
                centred = self.n * grid - sums.astype(np.int64)
                return np.einsum("ij,ij->i", centred, centred).tolist()
        out = []
        for row in grid:
            d = sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True))
            out.append(d if d <= _MOST else None)
        return out


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    rows = usable(vectors, id_col, vector_col)
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return None
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; the fit holds matrices of at most {MAX_DIMS}")
    n, sums = count_and_sums(rows, dims)
    blank = Whitening(n, sums, np.zeros((dims, 0)), [])
    covariance = second_moments(rows, dims, lambda batch: blank.centre(batch.column(0))) / n
    values, directions = eigen(covariance)
    total = float(np.trace(covariance))
    top = min(components, dims)
    # Rounding leaves about this much of a variance of zero.
    least = 8 * dims * _EPS * max(values[0] if dims else 0.0, 0.0) + _EPS**2
    scale = [1 / np.sqrt(v) if v > least else np.nan for v in values[:top]]
    shares = [float(max(v, 0.0) / total) if total > 0 else None for v in values[:top]]
    return Whitening(n, sums, directions[:, :top] * np.array(scale).reshape(1, -1), shares)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the measured covariance of the whitened vectors minus the identity."""
    real = np.flatnonzero(~np.isnan(model.scaled).any(axis=0))
    size = len(real)
    if not size:
        return None
    # The constant column gives the sums that centre the covariance.
    moments = second_moments(
        rows, size + 1, lambda b: np.column_stack([model.whiten(b.column(0))[:, real], np.ones(b.num_rows)])
    )
    mean = moments[:size, size] / model.n
    covariance = moments[:size, :size] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(size)).max())


def _apply(batch: pa.RecordBatch, model: Whitening, error: float | None) -> list:
    white = model.whiten(batch.column(1))
    rows, top = white.shape
    deviation = model.deviations(batch.column(1))
    ids = batch.column(0).to_pylist()
    flat = white.reshape(-1)
    return [
        [i for i in ids for _ in range(top)],
        np.tile(np.arange(1, top + 1, dtype=np.int32), rows),
        np.full(rows * top, model.n, dtype=np.int64),
        [d for d in deviation for _ in range(top)],
        pa.array(flat, pa.float64(), mask=np.isnan(flat)),
        list(model.explained) * rows,
        [error] * (rows * top),
    ]


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate, and the facts of the fit."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(vectors, components, id_col, vector_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return arrow_map(rows, _apply, SCHEMA, (model, identity_error(rows, model)))
