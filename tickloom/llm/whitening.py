"""Whitening of embeddings: covariance over the cluster, its leading eigenvectors, a projection.

Entries are whole numbers on a grid, so sums are exact and every centre is known to the last
bit. The covariance of the centred vectors is added up from one partial matrix per task; only
the matrix, whose size is that of a vector squared, comes to the driver. There it is reduced to
tridiagonal form by Householder reflections, the leading eigenvalues are enclosed by bisection
on Sturm counts, and their vectors follow by inverse iteration, kept orthogonal within clusters
of eigenvalues. The components go back to the tasks for the projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import table
from .vectors import decimals, matrix, row_blocks, usable_vectors, whole

SCALE, SHIFT = 64, 1_000_000  # grid of the entries: floor(SCALE * c) + SHIFT
MOST_DIMENSIONS = 4096  # the driver holds a few matrices of this side: 128 MB each
LARGEST = 2.0**62  # entries beyond this on the grid are no long numbers any more


# --- eigenvectors of a symmetric matrix ------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q' a Q, and the Householder vectors whose reflections make up Q."""
    a = a.copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max(initial=0.0)
        if scale == 0:  # the column has its form already
            reflections.append(np.zeros(0))
            continue
        u = x / max(scale, abs(x[0]))
        u[0] += math.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        p = 2 * (a[k + 1 :, k + 1 :] @ u)
        w = p - (p @ u) * u
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1, k] -= 2 * u[0] * (u @ x)
        reflections.append(u)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(n - 1)]), reflections


def rotated_back(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the tridiagonal form as those of the matrix."""
    out = vectors.copy()
    for k in reversed(range(len(reflections))):
        u = reflections[k]
        if len(u):
            out[k + 1 :] -= 2 * np.outer(u, u @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x: negative pivots of T - x."""
    square = np.concatenate([[0.0], off * off])
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(square.max()))
    pivot, below = np.ones(len(x)), np.zeros(len(x), np.int64)
    for d, s in zip(diagonal, square, strict=True):
        pivot = d - x - s / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling: all intervals are halved side by side."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = 2 * n * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    lo, hi = np.full(count, low - slack), np.full(count, high + slack)
    wanted = n - 1 - np.arange(count)  # the place of each value in rising order
    while True:
        middle = lo + (hi - lo) / 2
        open_ = (middle > lo) & (middle < hi)
        if not open_.any():
            return hi
        above = sturm_counts(diagonal, off, middle) <= wanted
        lo, hi = np.where(open_ & above, middle, lo), np.where(open_ & ~above, middle, hi)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Gaussian elimination with row exchanges of T - value; returns a function that solves for a right side."""
    n = len(diagonal)
    d, u1, u2 = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    low, swapped, factor = off.tolist(), [False] * n, [0.0] * n
    for i in range(n - 1):
        if abs(d[i]) < abs(low[i]):
            swapped[i] = True
            d[i], low[i] = low[i], d[i]
            u1[i], d[i + 1] = d[i + 1], u1[i]
            u2[i], u1[i + 1] = u1[i + 1], 0.0
        d[i] = d[i] if abs(d[i]) > least else least
        factor[i] = low[i] / d[i]
        d[i + 1] -= factor[i] * u1[i]
        u1[i + 1] -= factor[i] * u2[i]
    d[-1] = d[-1] if abs(d[-1]) > least else least

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.tolist()
        for i in range(n - 1):
            if swapped[i]:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor[i] * b[i]
        for i in reversed(range(n)):
            b[i] -= (u1[i] * b[i + 1] if i + 1 < n else 0.0) + (u2[i] * b[i + 2] if i + 2 < n else 0.0)
            b[i] /= d[i]
        return np.array(b)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values``; values closer together than a
    thousandth of the norm form a cluster, whose vectors are made orthogonal in every round."""
    n = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))))
    least = max(norm * np.finfo(float).eps, np.finfo(float).tiny)
    rng = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    begin = 0  # of the cluster
    shift = math.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            begin = k
        shift = value if k == begin else min(value, shift - 10 * least)  # equal values, different systems
        solve = _solver(diagonal, off, shift, least)
        v = rng.normal(size=n)
        for _ in range(rounds):
            v = solve(v / np.abs(v).max())
            v /= np.abs(v).max()
            for _ in range(2):
                v -= out[:, begin:k] @ (out[:, begin:k].T @ v)
            v /= np.linalg.norm(v)
        out[:, k] = v
    return out


def leading_eigenvectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as
    columns; the largest entry of each vector is positive. Values that are zero but for rounding are left out."""
    scale = float(np.abs(a).max(initial=0.0))
    if scale == 0 or not count:
        return np.zeros(0), np.zeros((len(a), 0))
    diagonal, off, reflections = tridiagonal(a / scale)
    values = leading_values(diagonal, off, min(count, len(a)))
    values = values[values > 16 * len(a) * np.finfo(float).eps * values[0]]
    vectors = rotated_back(inverse_iteration(diagonal, off, values), reflections)
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values * scale, vectors * signs


# --- sums over the cluster -------------------------------------------------


def on_grid(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def grid_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that can be whitened: usable vectors whose entries lie on the grid of long numbers."""
    return usable_vectors(df, vector).where(F.forall("vector", lambda x: F.abs(x * SCALE) < LARGEST))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension, of each length of vectors; halves of 32 bits can not overflow."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch["dim"])
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            for part in row_blocks(iter([rows]), dim):
                x = on_grid(matrix(part["vector"], dim))
                halves = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
                n[dim] = n.get(dim, 0) + len(x)
                total[dim] = total.get(dim, 0) + halves
    for dim, halves in total.items():
        yield table(dim=np.full(dim, dim, np.int32), i=np.arange(dim, dtype=np.int32), n=np.full(dim, n[dim]), high=halves[0], low=halves[1])


@dataclass(frozen=True)
class Centre:
    """Rows and exact sums of the fit list. ``whole`` + ``rest`` is the mean, whole numbers and the fraction left."""

    n: int
    sums: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])


def centre(vectors: DataFrame) -> Centre | None:
    """Exact sums of the vectors of the most frequent length (of equally many, the longer); None without rows."""
    parts = vectors.select("vector", "dim").mapInArrow(_sums, "dim int, i int, n long, high long, low long")
    each = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    whole_ = each.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "high", "low"))).alias("sums"))
    found = whole_.agg(F.max_by(F.struct("dim", "n", "sums"), F.struct("n", "dim")).alias("best")).first()["best"]
    if found is None:
        return None
    if found["dim"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {found['dim']} entries: at most {MOST_DIMENSIONS}")
    return Centre(found["n"], tuple((int(s["high"]) << 32) + int(s["low"]) for s in found["sums"]))


def _covariance(vectors: DataFrame, centred, width: int, dim: int, n: int) -> np.ndarray:
    """Sum of outer products over n of the rows that ``centred`` makes of a matrix: one partial matrix per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for part in row_blocks(batches, dim):
            d = centred(matrix(part["vector"], dim))
            total += d.T @ d
            seen = True
        if seen:
            i, j = np.triu_indices(width)
            yield table(i=i.astype(np.int32), j=j.astype(np.int32), v=total[i, j])

    cells = vectors.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j, v = (cells[c].to_numpy() for c in "ijv")
    out[i, j] = out[j, i] = v / n
    return out


@dataclass(frozen=True)
class Whitener:
    """Centre, components (unit columns), their eigenvalues and shares of the trace."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, c: np.ndarray) -> np.ndarray:
        """Whitened coordinates of vectors (rows)."""
        return _centred(self.centre)(c) @ (self.components / np.sqrt(self.values))


def _centred(at: Centre):
    whole_, rest = at.whole, at.rest
    return lambda c: (on_grid(c) - whole_) - rest


def fit(vectors: DataFrame, components: int = 32) -> Whitener | None:
    """The whitening of all ``vectors`` (see ``grid_vectors``); None without rows.

    Three passes: sums, centred covariance, and the covariance of the whitened rows, whose
    distance from the identity is reported.
    """
    at = centre(vectors)
    if at is None:
        return None
    same = vectors.where(F.col("dim") == at.dim)
    covariance = _covariance(same, _centred(at), at.dim, at.dim, at.n)
    values, axes = leading_eigenvectors(covariance, components)
    made = Whitener(at, axes, values, values / max(float(np.trace(covariance)), np.finfo(float).tiny), 0.0)
    if not len(values):
        return made
    # projections are linear, so the mean of the whitened rows is the projected mean: zero
    again = _covariance(same, made.project, len(values), at.dim, at.n)
    return Whitener(at, axes, values, made.explained, float(np.abs(again - np.eye(len(values))).max()))


def _deviations(at: Centre, c: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - sum)**2, exact."""
    off = on_grid(c) - at.whole
    rest = [s % at.n for s in at.sums]
    largest = at.n * (int(np.abs(off).max(initial=0)) + 1)
    if at.dim * largest**2 < 2**63:
        v = at.n * off - np.array(rest, np.int64)
        return whole(pa.array((v * v).sum(1)))
    v = at.n * off.astype(object) - np.array(rest, object)
    return decimals([int(s) for s in (v * v).sum(1)])


def whiten(df: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Whitened coordinates of every usable vector, one row per component.

    Returns vec_id, component (from 1, by falling eigenvalue), n (vectors in the fit list),
    deviation (decimal: sum over dimensions of (n * x - S)**2, exact), whitened, explained
    (share of the component in the trace) and identity_error. Null vectors, empty ones and
    those with null or non-finite entries (or entries beyond the long range) give no rows and
    are not in the fit list. Vectors of another length than the most frequent one are left out
    as well. Repeated rows count and come out as often as they are there; a null key stays
    null. Components of eigenvalue zero can not be scaled to one and are left out, so equal
    vectors alone, or an empty table, give no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = grid_vectors(df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "v")
    model = fit(vectors, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    dim, k = model.centre.dim, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in row_blocks(batches, max(dim, 8 * k)):
            c = matrix(part["vector"], dim)
            again = pa.array(np.repeat(np.arange(len(c)), k))
            yield table(
                vec_id=part["vec_id"].take(again), component=np.tile(np.arange(1, k + 1, dtype=np.int32), len(c)), n=np.full(len(c) * k, m.centre.n),
                deviation=_deviations(m.centre, c).take(again), whitened=m.project(c).ravel(), explained=np.tile(m.explained, len(c)), identity_error=np.full(len(c) * k, m.identity_error),
            )

    return vectors.where(F.col("dim") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(run, schema)
