"""Whitening of embeddings by spectral divide and conquer.

1. Entries become whole numbers, ``floor(256 * c)``. The fit list is each distinct vector
   once; equal vectors are put together before anything is shuffled.
2. Sums are exact. Vectors are centred on their rounded mean before they are multiplied, tasks
   add up products of whole numbers, and Spark adds the tasks' sums in limbs of 40 bits, so no
   size of table and no order of tasks changes a digit. The covariance is that fraction,
   rounded once.
3. The driver has the covariance, a matrix of the dimension's size whatever the table's. Its
   eigenvectors come from QDWH spectral divide and conquer: the polar factor of the shifted
   covariance, by dynamically weighted Halley steps on QR factors, is its matrix sign, and
   half of sign plus identity projects on the invariant subspace above the shift. Each
   subspace is split again until it is a line, or all its eigenvalues are equal. Only
   subspaces that hold leading components are split.
4. Mean and components are broadcast (components times dimension numbers), and rows are
   projected where they are.

Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those
with another number of entries than most (of equally many, the longest). Entries beyond the range of a long
are the ends of that range. Null ids and repeated rows stay, as rows. A component without
variance cannot be whitened and is left out, so a table of equal vectors has no components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seclog.llm.store import Scratch

SCALE = 256
#: Most entries of a vector: the driver holds a few matrices of that size.
MAX_DIM = 4096
_LIMB = 40
_EPS = float(np.finfo(float).eps)


# --- eigenvectors -------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: its matrix sign."""
    norm = min(np.linalg.norm(a), np.abs(a).sum(axis=0).max())
    x, low, one = a / norm, _EPS / 2, np.eye(len(a))
    for _ in range(20):
        root = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        weight = math.sqrt(1 + root) + 0.5 * math.sqrt(8 - 4 * root + 8 * (2 - low ** 2) / (low ** 2 * math.sqrt(1 + root)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.concatenate([math.sqrt(c) * x, one]))
        fresh = b / c * x + (weight - b / c) / math.sqrt(c) * q[:len(a)] @ q[len(a):].T
        fresh = (fresh + fresh.T) / 2
        moved = np.linalg.norm(fresh - x)
        x, low = fresh, min(low * (weight + b * low ** 2) / (1 + c * low ** 2), 1.0)
        if moved <= 1e-15 * len(a) ** 0.5 * 4 and 1 - low < 4 * _EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Where to part the eigenvalues: the middle of the diagonal, the mean, and places around it."""
    mean = float(np.trace(a)) / len(a)
    spread = float(np.linalg.norm(a - mean * np.eye(len(a)))) / math.sqrt(len(a))
    yield float(np.median(np.diag(a)))
    yield mean
    for k in range(1, 40):
        yield mean + spread * (-1) ** k * k / 50


def _parted(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of two invariant subspaces; the first one's eigenvalues are larger."""
    n, best = len(a), (np.inf, None)
    rng = np.random.Generator(np.random.PCG64(12))
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.any(moved):
            continue
        project = (polar(moved) + np.eye(n)) / 2
        rank = int(round(float(np.trace(project))))
        if not 0 < rank < n:
            continue
        q, _ = np.linalg.qr(project @ rng.standard_normal((n, rank)))
        q, _ = np.linalg.qr(project @ q, mode="complete")
        first, second = q[:, :rank], q[:, rank:]
        error = float(np.linalg.norm(second.T @ a @ first))
        if error < best[0]:
            best = error, (first, second)
        if error <= 4 * n * _EPS * scale:
            break
    if best[1] is None:
        raise ArithmeticError("no shift parts the eigenvalues")
    return best[1]


def eigen(a: np.ndarray, top: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    scale = float(np.linalg.norm(a)) if scale is None else scale
    if n == 1 or np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= n * _EPS * scale:
        values = np.diag(a).copy()
        order = np.argsort(-values, kind="stable")[:top]
        return values[order], np.eye(n)[:, order]
    first, second = _parted(a, scale)
    values, vectors = _within(a, first, min(top, first.shape[1]), scale)
    if top > first.shape[1]:
        more, others = _within(a, second, top - first.shape[1], scale)
        values, vectors = np.concatenate([values, more]), np.concatenate([vectors, others], axis=1)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _within(a: np.ndarray, basis: np.ndarray, top: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    inner = basis.T @ a @ basis
    _, vectors = eigen((inner + inner.T) / 2, top, scale)
    out = basis @ vectors
    out /= np.linalg.norm(out, axis=0)
    return np.einsum("ij,ij->j", out, a @ out), out


# --- exact sums ---------------------------------------------------------------------------


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as long; values beyond it become its ends."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    inside = (scaled >= -2.0 ** 63) & (scaled < 2.0 ** 63)
    ends = np.where(scaled > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), ends)


def products(rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of (x - centre) and of its products with itself, as Python ints."""
    dim = rows.shape[1]
    total, square = np.zeros(dim, object), np.zeros((dim, dim), object)
    if not len(rows):
        return total, square
    far = max(abs(int(rows.max()) - int(centre.min())), abs(int(rows.min()) - int(centre.max())), 1)
    if far > 1 << 26:
        moved = rows.astype(object) - centre.astype(object)
        return total + moved.sum(axis=0), square + moved.T @ moved
    step = (1 << 53) // far ** 2  # products of so many rows add up exactly in doubles
    for i in range(0, len(rows), step):
        moved = (rows[i:i + step] - centre).astype(np.float64)
        total += moved.sum(axis=0).astype(np.int64).astype(object)
        square += (moved.T @ moved).astype(np.int64).astype(object)
    return total, square


def _limbs(key: int, value: int) -> list[tuple[int, int, int]]:
    """(key, limb number, limb) of a whole number; each limb has its sign."""
    out, sign, value, limb = [], (-1 if value < 0 else 1), abs(value), 0
    while value:
        out.append((key, limb, sign * (value & ((1 << _LIMB) - 1))))
        value, limb = value >> _LIMB, limb + 1
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, centre: np.ndarray, squares: bool) -> tuple[int, list[int]]:
    """Number of vectors and, by position, sums of x - centre or (upper triangle) of its products."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _vectors(batch.column(0), dim)
            if squares:
                part = products(rows, centre)[1][upper]
            else:
                low = (rows & ((1 << _LIMB) - 1)).sum(axis=0).astype(object)
                part = low + (rows >> _LIMB).sum(axis=0).astype(object) * (1 << _LIMB)
            n, held = n + len(rows), part if held is None else held + part
        if n:
            found = [(-1, 0, n), *(x for k, v in enumerate(held) for x in _limbs(k, int(v)))]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["at", "limb", "part"])

    rows = fit.mapInArrow(run, "at long, limb long, part long").groupBy("at", "limb").agg(F.sum("part").alias("part")).collect()  # a few numbers for each entry
    size = len(upper[0]) if squares else dim
    out, n = [0] * size, 0
    for r in rows:
        if r["at"] < 0:
            n = r["part"]
        else:
            out[r["at"]] += r["part"] << (_LIMB * r["limb"])
    return n, out


# --- operator -----------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit gives: ``vectors`` has a component in each row, leading first."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def _parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([(s - int(c) * self.n) / self.n for s, c in zip(self.sums, centre)])
        return centre, rest, (self.vectors / np.sqrt(self.values)[:, None]).T

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors: their difference from the mean is rounded once."""
        centre, rest, turn = self._parts()
        if max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) >= 1 << 62:
            moved = (rows.astype(object) - centre.astype(object)).astype(np.float64)
        else:
            moved = (rows - centre).astype(np.float64)
        return (moved - rest) @ turn

    def deviation(self, rows: np.ndarray) -> pa.Array:
        """Sum over all entries of (n * x - sum)^2; null where a long cannot hold it."""
        most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * self.n + max(map(abs, self.sums))
        if most ** 2 * self.dim < 1 << 63:
            far = rows * self.n - np.array(self.sums, np.int64)
            return pa.array((far * far).sum(axis=1))
        far = rows.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()], pa.int64())

    def apply(self, table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """(key, deviation long, whitened array of doubles, one for each component) of all usable rows."""
        shared = table.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                usable, rows = _usable(batch.column(1), model.dim)
                if not len(rows):
                    continue
                out = model.project(rows)
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1])
                yield pa.record_batch([batch.column(0).filter(usable), model.deviation(rows), pa.ListArray.from_arrays(at, pa.array(out.reshape(-1)))],
                                      [key, "deviation", "whitened"])

        return (table.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
                .mapInArrow(run, f"`{key}` long, deviation long, whitened array<double>"))


def _usable(column: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Which rows take part, and their vectors as whole numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    values = column.filter(fits).flatten()
    numbers = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(numbers).all(axis=1)
    mask = fits.to_numpy(zero_copy_only=False).copy()
    mask[mask] = finite
    return pa.array(mask), whole(numbers[finite])


def fit(table: DataFrame, components: int = 4, vector: str = "embedding") -> Whitening | None:
    """The leading ``components`` of the distinct vectors of ``table``; None if it has no usable vector."""
    spark = table.sparkSession
    rows = table.select(F.col(vector).cast("array<double>").alias("v"))
    length = (rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), F.desc("dim")).first())
    if length is None:
        return None
    dim = length["dim"]
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIM}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _usable(batch.column(0), dim)
            yield pa.record_batch([pa.array([r.tobytes() for r in found], pa.binary())], ["x"])

    scratch = Scratch(spark, "whitening")
    distinct = scratch.keep(rows.mapInArrow(pack, "x binary").distinct(), "fit")
    n, sums = _summed(distinct, dim, np.zeros(dim, np.int64), squares=False)
    if not n:
        scratch.drop("fit")
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    _, upper = _summed(distinct, dim, centre, squares=True)
    rest = [s - int(c) * n for s, c in zip(sums, centre)]
    covariance, places = np.zeros((dim, dim)), np.triu_indices(dim)
    trace = 0
    for i, j, total in zip(places[0].tolist(), places[1].tolist(), upper):
        exact = n * total - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = exact / n ** 2
        trace += exact if i == j else 0
    values, vectors = eigen(covariance, min(components, dim)) if trace else (np.zeros(0), np.zeros((dim, 0)))
    there = values > dim * _EPS * values.max(initial=0)
    model = Whitening(dim, n, sums, values[there], vectors[:, there].T.copy(), [float(e) * n ** 2 / trace for e in values[there]])
    model.identity_error = _identity_error(distinct, model)
    scratch.drop("fit")
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on all its vectors."""
    k = len(model.values)
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                out = shared.value.project(_vectors(batch.column(0), shared.value.dim))
                square, total = square + out.T @ out, total + out.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([square.reshape(-1), total]))], ["at", "part"])

    sums = np.zeros(k * k + k)
    for r in distinct.mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():  # k * k + k rows
        sums[r["at"]] = r["part"]
    mean = sums[k * k:] / model.n
    return float(np.abs(sums[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def report(table: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    model = fit(table, components)
    if model is None or not len(model.values):
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(x) for x in model.explained))
    return (model.apply(table).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error")))
