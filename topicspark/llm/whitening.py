"""Embedding whitening by incremental eigendecomposition (operator 12).

Entries become whole numbers (``floor(scale * c)``); the model is fitted on the
distinct vectors.  Each task holds the spectrum of the scatter of its vectors
around their mean, and changes it with every vector by a centred rank-one
update: the new eigenvalues are the roots of a secular equation, found for all
intervals at once, each measured from its nearer pole; parts of the update
that vanish and equal eigenvalues are deflated first, and the vector is
recomputed from the roots so that the eigenvectors stay orthogonal.  Spectra of
two sets combine by one rank-one update for each eigenpair of the second and
one for the difference of the means; sets combine over a tree, ``FAN`` at a
time.  The last spectrum is a basis only: a pass over all vectors projects the
centred vectors on it, and the small matrix of that covariance gives the
eigenpairs (Rayleigh-Ritz with the whole basis), so errors gathered on the way
don't reach the result.

The driver and each task hold matrices of dims x dims numbers.

Defined cases: vectors that are null, empty, or hold null or non-finite entries
take no part, nor do those whose length is not the most frequent one (ties: the
longer); vectors that repeat count once in the fit, and each of their rows has
results; components whose eigenvalue is zero to double precision (equal
vectors, few vectors) are left out; ``deviation`` is null where it exceeds a
long; an empty table gives an empty result; rows without an id have a null
vec_id, other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.session import materialize

SCALE = 256
ROWS_PER_TASK = 4096
MOST_TASKS = 4096
FAN = 16
EPS = np.finfo(float).eps


# eigenpairs of diag(d) + rho z z'

def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z'; d rises strictly, z has no zero, rho > 0."""
    m = len(d)
    if m == 1:
        return d + rho * z * z, np.ones((1, 1))
    z2 = (rho * z * z)[:, None]
    reach = z2.sum()
    at = np.arange(m)
    half = 0.5 * np.r_[np.diff(d), reach]
    f = 1 + (z2 / ((d[:, None] - d) - half)).sum(0)
    right = (f < 0) & (at < m - 1)  # the root lies in the right half: measure from the right pole
    origin = at + right
    lo = np.where(right, -half, np.where((at == m - 1) & (f < 0), half, 0.0))
    hi = np.where(right, 0.0, np.where((at == m - 1) & (f < 0), 2 * half, half))
    delta = d[:, None] - d[origin]
    below = (at[:, None] <= at).astype(float)  # poles up to the root's own
    all_poles = np.ones(m)
    last = at == m - 1
    beside = np.minimum(at + 1, m - 1)
    tau = 0.5 * (lo + hi)
    with np.errstate(all="ignore"):
        for step in range(100):
            gap = delta - tau
            term = z2 / gap
            total, left = all_poles @ term, np.einsum("ij,ij->j", below, term)
            f = 1 + total
            done = np.abs(f) <= 2 * EPS * m * (1 + total - 2 * left)
            low = f < 0
            lo, hi = np.where(low, tau, lo), np.where(low, hi, tau)
            if np.all(done | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))):
                break
            term /= gap
            slope, left_slope = all_poles @ term, np.einsum("ij,ij->j", below, term)
            one, two = gap[at, at], gap[beside, at]
            c = f - one * left_slope - two * (slope - left_slope)
            a = (one + two) * f - one * two * slope
            b = one * two * f
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # beyond the last pole: that pole and a constant
            move = np.where(last, one + slope * one * one / (f - slope * one), move)
            new = tau + move
            good = (new > lo) & (new < hi)
            if step > 12 and step % 3 == 0:
                good[:] = False
            tau = np.where(done, tau, np.where(good, new, 0.5 * (lo + hi)))
    gap = delta - tau  # d_j - root_i without cancellation
    apart = d - d[:, None]
    np.fill_diagonal(apart, 1.0)
    zz = np.sign(z) * np.sqrt(np.abs(np.prod(-gap / apart, axis=1)))
    q = zz[:, None] / gap
    q /= np.sqrt((q * q).sum(0))
    return d[origin] + tau, q


def _gather(d: np.ndarray, u: np.ndarray, z: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Turn the eigenvectors of (nearly) equal eigenvalues so that z has one entry in each such group."""
    s = 0
    while s < len(d):
        e = s + 1
        while e < len(d) and d[e] - d[s] <= tol:
            e += 1
        if e - s > 1:
            v = z[s:e].copy()
            size = np.sqrt(v @ v)
            if size > 0:
                v[-1] += np.copysign(size, v[-1])
                v /= np.sqrt(v @ v)
                u[:, s:e] -= 2 * np.outer(u[:, s:e] @ v, v)
                z[s:e] = np.r_[np.zeros(e - s - 1), -np.copysign(size, z[e - 1])]
        s = e
    return u, z


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of u diag(d) u' + rho v v', eigenvalues rising."""
    z = u.T @ v
    size = np.sqrt(z @ z)
    if rho * size * size == 0:
        return d, u
    z, rho = z / size, rho * size * size
    tol = 8 * EPS * max(abs(d[-1]), rho)
    if (np.diff(d) <= tol).any():
        u, z = _gather(d, u.copy(), z, tol)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(live):
        return d, u
    if len(live) == len(d):
        d, q = secular(d, z, rho)
        return d, u @ q
    roots, q = secular(d[live], z[live], rho)
    d, u = d.copy(), u.copy()
    d[live] = roots
    u[:, live] = u[:, live] @ q
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


@dataclass
class Spectrum:
    """Eigenpairs of the scatter of n vectors around their mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> Spectrum:
        if not self.n or not other.n:
            return self if self.n else other
        d, u = self.values, self.vectors
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                d, u = rank_one(d, u, vector, value)
        n, away = self.n + other.n, other.mean - self.mean
        d, u = rank_one(d, u, away, self.n * other.n / n)
        return Spectrum(n, self.mean + away * (other.n / n), d, u)

    def row(self, slot: int) -> dict:
        return {"slot": slot, "n": self.n, "mean": self.mean.tobytes(), "values": self.values.tobytes(), "vectors": np.ascontiguousarray(self.vectors).tobytes()}

    @classmethod
    def read(cls, r) -> Spectrum:
        mean = np.frombuffer(r["mean"])
        return cls(int(r["n"]), mean, np.frombuffer(r["values"]), np.frombuffer(r["vectors"]).reshape(len(mean), -1))


SPECTRUM = "slot bigint, n bigint, mean binary, values binary, vectors binary"


# vectors as whole numbers

def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """((vec_id, x array<bigint>) of the vectors that take part, their length)."""
    c = F.col(vec_col)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    good = vectors.filter(c.isNotNull() & (F.size(c) > 0) & ~bad)
    top = good.groupBy(F.size(c).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = top["dims"] if top else 0
    x = F.transform(c, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return good.filter(F.size(c) == dims).select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Whitener:
    """n and sums of the distinct vectors, eigenvalues from the largest, components as columns, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: machine integers where they suffice."""
        if len(x) and self.n * max(int(x.max()), -int(x.min()), 1) + max(map(abs, self.sums)) >= 1 << 62:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        off = self.offsets(x)
        if off.dtype != object and len(off) and off.shape[1] * int(np.abs(off).max()) ** 2 >= 1 << 63:
            off = off.astype(object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()]

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.values[:k])


def _over(frame: DataFrame, dims: int, summary, schema: str) -> DataFrame:
    """One call of ``summary`` with a generator of all matrices of a task; it returns rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = summary(_matrix(b.column(0), dims) for b in batches if b.num_rows)
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return frame.mapInArrow(run, schema)


def _sums(points: DataFrame, dims: int) -> tuple[int, list[int]]:
    def summary(parts):
        n, total = 0, [0] * dims
        for x in parts:
            n += len(x)
            small = len(x) * int(max(x.max(), -x.min(), 1)) < 1 << 62
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(0), strict=True)]
        return [{"dim": i, "n": n, "total": str(t)} for i, t in enumerate(total)] if n else []

    rows = (_over(points, dims, summary, "dim bigint, n bigint, total string")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    rows = sorted(rows, key=lambda r: r["dim"])
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def spectrum(points: DataFrame, dims: int) -> Spectrum:
    """The combined spectrum of all vectors (x) in ``points``, which have at most ``MOST_TASKS`` partitions."""
    def summary(parts):
        s = Spectrum.empty(dims)
        for x in parts:
            for v in x.astype(float):
                s.add(v)
        return [s.row(TaskContext.get().partitionId())] if s.n else []

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Spectrum.empty(dims)
        for r in pdf.sort_values("slot").to_dict("records"):
            s = s.combine(Spectrum.read(r))
        return pd.DataFrame([s.row(int(pdf["slot"].iloc[0]) // FAN)])

    level = _over(points, dims, summary, SPECTRUM)
    left = MOST_TASKS
    while left > FAN:
        level = level.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(combine, SPECTRUM)
        left = -(-left // FAN)
    s = Spectrum.empty(dims)
    for r in sorted(level.collect(), key=lambda r: r["slot"]):  # at most FAN rows
        s = s.combine(Spectrum.read(r))
    return s


def fit(points: DataFrame, dims: int) -> tuple[Whitener, DataFrame]:
    """(model, the distinct vectors as a written table), fitted on the distinct x of ``points``."""
    spark = points.sparkSession
    distinct = materialize(points.select("x").distinct(), "whole-vectors")
    n, sums = _sums(distinct, dims)
    if not n:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), distinct
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)))
    basis = spectrum(distinct.repartition(tasks, "x"), dims).vectors
    model = Whitener(n, sums, np.zeros(0), basis, 0.0)

    def projected(parts):
        total = np.zeros((dims, dims))
        for x in parts:
            p = model.centred(x) @ basis
            total += p.T @ p
        return [{"i": i, "row": r} for i, r in enumerate(total.tolist())]

    cells = (_over(distinct, dims, projected, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    small = np.zeros((dims, dims))
    for r in cells:
        small[r["i"], r["j"]] = r["v"] / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    components = (basis @ turn)[:, ::-1]
    components = components / np.sqrt((components * components).sum(0))
    components = components * np.where(components[np.abs(components).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
    values, trace = values[::-1], float(np.trace(small))
    live = int((values > 16 * dims * EPS * trace).sum())
    return Whitener(n, sums, values[:live], components[:, :live], trace), distinct


def identity_error(model: Whitener, distinct: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the k whitened components minus the identity."""
    def moments(parts):
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for x in parts:
            w = model.whiten(x, k)
            m = w.mean(0)
            away = m - mean
            scatter += (w - m).T @ (w - m) + np.outer(away, away) * (n * len(w) / (n + len(w)))
            n += len(w)
            mean = mean + away * (len(w) / n)
        return [{"n": n, "mean": mean.tolist(), "scatter": scatter.ravel().tolist()}] if n else []

    rows = _over(distinct, len(model.sums), moments, "n bigint, mean array<double>, scatter array<double>").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(r["n"] * np.array(r["mean"]) for r in rows) / n
    scatter = sum(np.array(r["scatter"]).reshape(k, k) + r["n"] * np.outer(np.array(r["mean"]) - mean, np.array(r["mean"]) - mean) for r in rows)
    return float(np.abs(scatter / n - np.eye(k)).max())


def transform(points: DataFrame, model: Whitener, k: int) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row of ``points``."""
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dims)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.deviation(x), pa.int64()), pa.array(model.whiten(x, k).tolist(), pa.list_(pa.float64()))],
                                                 names=["vec_id", "deviation", "whitened"])

    return points.mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whitening_report(vectors: DataFrame, k: int = 4, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component: its whitened value and the fit's figures."""
    points, dims = whole_vectors(vectors, scale=scale)
    model, distinct = fit(points, dims)
    k = min(k, len(model.values))
    spark = vectors.sparkSession
    if not k:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(model, distinct, k)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    return (transform(points, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                    share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))
