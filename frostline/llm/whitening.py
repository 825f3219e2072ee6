"""Whitening of embeddings: Welford's updates in each partition, merged by the parallel formula, and a symmetric QR solve.

A partition's iterator takes its vectors one by one: the mean moves by a fraction of the difference, the scatter grows by
the product of the differences before and after. States of partitions (count, mean, scatter, exact sums) are merged a few
at a time, level by level, in tasks, so that the driver gets one state of a size that only the dimensions decide. It is
made tridiagonal there and solved by QR steps with implicit shifts. Vectors are then projected where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, stage_table

SCALE, SHIFT = 64.0, 1_000_000
MOST_DIMENSIONS = 4096  # a state of so many is 134 MB; more is an error, nothing is cut
FAN_IN = 16  # states that a task merges at a time
_LARGEST = float(1 << 62)
_STATE = "length int, n long, mean binary, scatter binary, sums array<string>"


@dataclass
class Moments:
    """Count, mean, scatter (sum of products of differences from the mean) and exact sums of whole-number vectors.

    The mean and the scatter are of the vectors less SHIFT, which changes no covariance and saves digits.
    """

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, dims: int) -> Moments:
        return cls(0, np.zeros(dims), np.zeros((dims, dims)), [0] * dims)

    def add(self, vector: np.ndarray) -> None:
        """Welford's rank-one update by one vector."""
        self.n += 1
        before = vector - self.mean
        self.mean += before / self.n
        self.scatter += np.multiply.outer(before, vector - self.mean)

    def merge(self, other: Moments) -> None:
        """The state of both lists, by the parallel formula."""
        n = self.n + other.n
        if other.n:
            apart = other.mean - self.mean
            self.scatter += other.scatter + np.multiply.outer(apart, apart * (self.n * other.n / n))
            self.mean += apart * (other.n / n)
            self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "scatter": self.scatter.tobytes(), "sums": [str(s) for s in self.sums]}

    @classmethod
    def of(cls, row: dict) -> Moments:
        mean = np.frombuffer(row["mean"]).copy()
        return cls(row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1).copy() if len(mean) else np.zeros((0, 0)), [int(s) for s in row["sums"]])

    def covariance(self) -> np.ndarray:
        cov = self.scatter / self.n
        return (cov + cov.T) / 2


def _tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, the entries beside it, and the rotation's transpose, by Householder's reflections."""
    a, d = matrix.copy(), len(matrix)
    turned = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        turned[k + 1 :] -= 2 * np.outer(v, v @ turned[k + 1 :])
    return a.diagonal().copy(), a.diagonal(-1).copy(), turned


def eigen(matrix: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows, by QR steps with implicit shifts.

    The first entry of a vector that isn't tiny is positive, so that runs agree in sign.
    """
    d = len(matrix)
    if d == 0:
        return np.zeros(0), np.zeros((0, 0))
    diag, beside, rows = _tridiagonal(np.asarray(matrix, float))
    high = d - 1
    steps = 0
    while high > 0:
        tiny = np.finfo(float).eps * (np.abs(diag[:-1]) + np.abs(diag[1:]))
        beside[np.abs(beside) <= tiny] = 0.0
        if beside[high - 1] == 0.0:
            high, steps = high - 1, 0
            continue
        low = high - 1
        while low > 0 and beside[low - 1] != 0.0:
            low -= 1
        steps += 1
        if steps > most_steps:
            raise RuntimeError("the QR steps don't converge")
        _qr_step(diag, beside, rows, low, high)
    order = np.argsort(-diag, kind="stable")
    values, vectors = diag[order], rows[order]
    first = np.argmax(np.abs(vectors) > 0.5 / math.sqrt(d), axis=1)
    return values, vectors * np.where(vectors[np.arange(d), first] < 0, -1.0, 1.0)[:, None]


def _qr_step(diag: np.ndarray, beside: np.ndarray, rows: np.ndarray, low: int, high: int) -> None:
    """One step on the block from low to high: rotations chase the entry that the shift brings in out of the matrix."""
    half = (diag[high - 1] - diag[high]) / 2
    edge = beside[high - 1]
    shift = diag[high] - edge * edge / (half + math.copysign(math.hypot(half, edge), half))
    x, z = diag[low] - shift, beside[low]
    for k in range(low, high):
        size = math.hypot(x, z)
        c, s = (x / size, z / size) if size else (1.0, 0.0)
        if k > low:
            beside[k - 1] = size
        p, q, e = diag[k], diag[k + 1], beside[k]
        diag[k] = c * c * p + 2 * c * s * e + s * s * q
        diag[k + 1] = s * s * p - 2 * c * s * e + c * c * q
        beside[k] = c * s * (q - p) + (c * c - s * s) * e
        if k < high - 1:
            x, z = beside[k], s * beside[k + 1]
            beside[k + 1] *= c
        above = rows[k].copy()
        rows[k] = c * above + s * rows[k + 1]
        rows[k + 1] = c * rows[k + 1] - s * above


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, name: str) -> Iterable[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        yield dims, batch.take(pa.array(np.flatnonzero(lengths == dims)))


def _exact_sums(x: np.ndarray) -> list[int]:
    top = int(np.abs(x).max(initial=0))
    return (x.sum(axis=0) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)).tolist()


def _scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each length of the partition's vectors."""
    found: dict[int, Moments] = {}
    for batch in source:
        for dims, part in _by_length(batch, "x"):
            x = _matrix(part.column("x"))
            state = found.setdefault(dims, Moments.empty(dims))
            for vector in (x - SHIFT).astype(float):
                state.add(vector)
            state.sums = [a + b for a, b in zip(state.sums, _exact_sums(x), strict=True)]
    yield from _rows(found)


def _rows(states: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    """A row for each state, under the length of the vectors that it stands for."""
    kinds = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("sums", pa.list_(pa.string()))])
    for length, state in states.items():
        yield pa.RecordBatch.from_pylist([{"length": length} | state.row()], kinds)


def _merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Moments] = {}
    for batch in source:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            state = Moments.of(row)
            found.setdefault(row["length"], Moments.empty(len(state.mean))).merge(state)
    yield from _rows(found)


def _merged(states: DataFrame) -> dict[int, Moments]:
    """One state for each length. States are merged FAN_IN partitions at a time, each level staged."""
    states = stage_table(states)
    while (parts := states.groupBy("length").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = math.ceil(parts / FAN_IN)
        states = stage_table(states.repartition(groups).mapInArrow(_merge, _STATE))
    return {row["length"]: Moments.of(row.asDict()) for row in states.collect()}


@dataclass
class Whitener:
    """What projects vectors of one length: the fit list's count, sums and mean, and the leading components."""

    n: int
    sums: list[int]
    axes: np.ndarray  # unit eigenvectors, one a row
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def fit(cls, moments: Moments, components: int) -> Whitener:
        """Components of which the variance is nothing but rounding are left out, as nothing can be made of unit variance
        from them."""
        cov = moments.covariance()
        values, axes = eigen(cov)
        total = float(np.trace(cov))
        k = int((values[:components] > 1e-12 * max(total, 1e-300)).sum()) if len(values) else 0
        return cls(moments.n, moments.sums, axes[:k], values[:k], values[:k] / total if total else values[:k])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        middle = np.array([float(s // self.n) for s in self.sums]), np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - middle[0] - middle[1]) @ self.axes.T) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - sums) squared, for each row."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        fits = most * most * max(1, x.shape[1]) < 1 << 62
        d = x * self.n - np.array(self.sums, np.int64) if fits else x.astype(object) * self.n - np.array(self.sums, object)
        if not fits and (narrow := int(np.abs(d).max(initial=0))) * narrow * max(1, x.shape[1]) < 1 << 62:
            d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()


def _whole(column: Column) -> Column:
    return F.transform(column, lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT))


def _usable(column: Column) -> Column:
    """Not null, and each entry neither null, nor NaN, nor infinite, nor too large for a long."""
    held = F.forall(column, lambda c: F.coalesce(F.abs(F.lit(SCALE) * c.cast("double")) < F.lit(_LARGEST), F.lit(False)))
    return column.isNotNull() & held


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, x) of the rows that can be used: floor(64 c) + 1000000 of every entry c."""
    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(_usable(F.col("_v"))).select("_id", _whole(F.col("_v")).alias("x"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, most_dimensions: int = MOST_DIMENSIONS) -> DataFrame:
    """One row per vector that can be used: id_col, n, deviation, identity_error, and the arrays whitened and explained.

    Entries become whole numbers x = floor(64 c) + 1000000. The fit list has each distinct vector of those once: n of them,
    with exact sums S. deviation is the sum over dimensions of (n x - S) squared, exact, and null where that takes more
    than 38 digits. whitened is x - S/n along the unit eigenvectors of the fit list's covariance (divisor n), over the root
    of the eigenvalue, for the largest components, falling; explained is each eigenvalue's share of the trace.
    identity_error is measured in a second pass: how far the whitened fit list's covariance is from the identity.

    Vectors that are null, or have entries that are null, not finite, or beyond 2^56 have no row. Vectors of different
    lengths are fitted by length, each with its own n. Repeated and tied vectors count once in the fit list and have a row
    each; null ids are ids. Components without variance are left out: one distinct vector, or an empty one, has an empty
    array. Equal eigenvalues have the components that the solver finds. Covariances larger than one of most_dimensions (those
    of all lengths together) are an error. An empty table gives no rows, and other columns don't matter.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    fit = stage_table(rows.select("x").distinct())
    size = fit.select(F.size("x").cast("double").alias("d")).distinct().agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0
    if size > most_dimensions**2:
        raise ValueError(f"covariances of {size:.0f} entries; most_dimensions is {most_dimensions}")
    models = {d: Whitener.fit(m, components) for d, m in _merged(fit.mapInArrow(_scan, _STATE)).items()}
    for d, error in _identity_errors(fit, models).items():
        models[d].identity_error = error

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for dims, batch in _by_length(whole, "x"):
                x, m = _matrix(batch.column("x")), models[dims]
                white = m.project(x) if dims else np.zeros((len(x), 0))
                far = [str(v) if v < 10**38 else None for v in m.deviation(x)]
                n = len(x)
                yield append_columns(batch, ["_id"], {
                    "n": pa.array([m.n] * n, pa.int64()), "deviation": pa.array(far, pa.string()), "identity_error": pa.array([m.identity_error] * n, pa.float64()),
                    "whitened": pa.array(list(white), pa.list_(pa.float64())), "explained": pa.array([m.explained.tolist()] * n, pa.list_(pa.float64())),
                })

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n long, deviation string, identity_error double, whitened array<double>, explained array<double>"
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "identity_error", "whitened", "explained")


def _identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """For each length the largest entry by which the covariance of the whitened fit list differs from the identity."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for whole in source:
            for dims, batch in _by_length(whole, "x"):
                m = models[dims]
                state = found.setdefault(dims, Moments.empty(len(m.values)))
                if dims:
                    for vector in m.project(_matrix(batch.column("x"))):
                        state.add(vector)
        yield from _rows(found)

    merged = _merged(fit.mapInArrow(run, _STATE))
    return {length: float(np.abs(m.covariance() - np.eye(len(m.mean))).max(initial=0.0)) for length, m in merged.items()}
