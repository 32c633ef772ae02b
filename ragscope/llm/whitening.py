"""Whitening by spectral divide and conquer with QDWH polar decompositions.

Each entry c of a vector becomes the integer x = floor(64 * c) + 1,000,000. The
fit list holds each distinct x vector once; Spark sums it exactly, then the
products of its centred entries. The covariance (dimension x dimension,
whatever the number of rows) is decomposed on the driver: the polar factor U of
covariance - s * I, by the dynamically weighted Halley iteration with QR
factorisations, gives the projector (U + I) / 2 onto the eigenvectors above s;
an orthonormal basis of its range and of the rest splits the matrix into two
smaller ones, and so on, down to single components, the larger eigenvalues
first and only as far as components are wanted. Means and components, of fixed
size, go to all tasks, which project every row.

Rows whose vector is null or holds null or non-finite entries are dropped; so
are empty vectors, and vectors whose length is not the table's most frequent
one (the longer where two are as frequent), which lie in no common space.
Entries beyond what 64 * c fits into a long saturate. Repeated vectors count
once in the fit list and keep all their rows; repeated ids and null ids keep
theirs. A component without variance (eigenvalue at most 1e-12 of the largest)
cannot be scaled to one and is left out, so a table of one distinct vector has
no rows at all. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
#: An eigenvalue's least share of the largest one.
LEAST = 1e-12


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the sound vectors of the most frequent length."""
    c = F.col(column)
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", x.alias("x"))
    usual = (kept.groupBy(F.size("x").alias("k")).agg(F.count(F.lit(1)).alias("c"))
             .agg(F.max(F.struct("c", "k")).alias("m")).first()["m"])
    return kept.where(F.size("x") == (usual["k"] if usual else 0))


def entries(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """A batch's vectors as a matrix of integers."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                y = entries(batch) - SHIFT
                small = int(np.abs(y).max()) < (1 << 62) // len(y)
                y = (y if small else y.astype(object)).sum(0).tolist()
                n, total = n + batch.num_rows, y if total is None else [s + t for s, t in zip(total, y)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t + n * SHIFT) for t in total], pa.decimal128(38)),
                 pa.array([n] * len(total), pa.int64())], names=["i", "s", "n"])

    # a row per dimension, however many tasks there were
    per = (fit.mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i")
           .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    return (per[0].n if per else 0), [int(r.s) for r in per]


def product_sums(fit: DataFrame, rows) -> np.ndarray:
    """Sum of y y' and of y over the fit list, y = rows(batch): one matrix per
    task, added up by Spark, entry by entry."""
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = rows(batch)
            y = np.concatenate((y, np.ones((len(y), 1))), axis=1)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "v"])

    # dimension * dimension rows, however many tasks there were
    sums = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max(r.i for r in sums)
    out = np.zeros((size, size))
    for r in sums:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums])
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def covariance(products: np.ndarray, n: int) -> np.ndarray:
    """Divisor n, about the mean of what was added up."""
    mean = products[:-1, -1] / n
    return products[:-1, :-1] / n - np.outer(mean, mean)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH iterations."""
    m = len(a)
    x = a / np.linalg.norm(a)  # singular values at most 1
    # a lower bound of the least one, from the triangular factor
    try:
        inverse = np.linalg.norm(np.linalg.inv(np.linalg.qr(x, mode="r")))
    except np.linalg.LinAlgError:
        inverse = np.inf
    low = min(max(1 / inverse, 1e-17), 1.0) if inverse > 0 else 1e-17
    for _ in range(40):
        d = np.cbrt(4 * max(1 - low * low, 0) / low**4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)), 0))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        both, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, np.eye(m))))
        nxt = q / c * x + (p - q / c) / np.sqrt(c) * both[:m] @ both[m:].T
        nxt = (nxt + nxt.T) / 2
        moved = np.linalg.norm(nxt - x)
        x, low = nxt, min(low * (p + q * low * low) / (1 + c * low * low), 1.0)
        if low > 1 - 1e-15 and moved < 1e-14 * np.sqrt(m):
            break
    return x


def subspaces(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest."""
    rng = np.random.default_rng(0)
    m = len(projector)
    start = np.concatenate((projector @ rng.normal(size=(m, rank)),
                            (np.eye(m) - projector) @ rng.normal(size=(m, m - rank))), axis=1)
    q, _ = np.linalg.qr(start)
    # once more, so that the bases are as good as the projector
    q, _ = np.linalg.qr(np.concatenate((projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]), axis=1))
    return q[:, :rank], q[:, rank:]


def _shifts(a: np.ndarray):
    """Places to split a spectrum: the median of the diagonal, the mean of the
    spectrum, which always lies inside it, and others between its bounds."""
    diagonal = np.sort(np.diagonal(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    for share in (0.37, 0.61, 0.83, 0.19, 0.93, 0.07):
        yield float(diagonal[0] + share * (diagonal[-1] - diagonal[0]))
    radius = np.abs(a).sum(1) - np.abs(np.diagonal(a))
    low, high = (np.diagonal(a) - radius).min(), (np.diagonal(a) + radius).max()
    for share in (0.5, 0.71, 0.29, 0.87, 0.13):
        yield float(low + share * (high - low))


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below some shift; None where
    all eigenvalues are equal to rounding."""
    m = len(a)
    if np.linalg.norm(a - np.trace(a) / m * np.eye(m)) <= 4 * np.finfo(float).eps * scale:
        return None
    best = None
    for shift in _shifts(a):
        projector = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < m:
            continue
        upper, lower = subspaces(projector, rank)
        error = float(np.abs(lower.T @ a @ upper).max())
        if best is None or error < best[0]:
            best = error, upper, lower
        if error <= 16 * np.finfo(float).eps * scale * np.sqrt(m):
            break
    return best[1:] if best else None


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors."""
    v = (v + v.T) / 2
    scale = max(float(np.linalg.norm(v)), np.finfo(float).tiny)

    def descend(basis: np.ndarray, want: int) -> list[np.ndarray]:
        if want <= 0:
            return []
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        parts = split(a, scale) if len(a) > 1 else None
        if parts is None:
            return [basis]
        upper, lower = basis @ parts[0], basis @ parts[1]
        return descend(upper, want) + descend(lower, want - upper.shape[1])

    blocks = descend(np.eye(len(v)), wanted)
    q, _ = np.linalg.qr(np.concatenate(blocks, axis=1))
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], q[:, order]


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: ``n`` and ``sums`` of the fit list, eigenvalues and
    eigenvectors, and the share of the variance that each explains."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct x vector once."""
    return materialize(vectors.select("x").distinct(), "fit")


def fit(distinct: DataFrame, wanted: int = 16) -> Whitening | None:
    """The whitening of a fit list; None where it is empty."""
    n, sums = exact_sums(distinct)
    if not n:
        return None
    v = covariance(product_sums(distinct, lambda batch: centred(entries(batch), n, sums)), n)
    values, q = components(v, wanted)
    live = values > max(LEAST * values[0], 0)
    total = float(np.trace(v))
    return Whitening(n, sums, values[live], q[:, live], values[live] / total if total else values[live])


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance - identity."""
    if not len(model.values):
        return 0.0
    c = covariance(product_sums(distinct, lambda batch: model.apply(entries(batch))), model.n)
    return float(np.abs(c - np.eye(len(c))).max())


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 by row, exact; None where a long cannot hold it."""
    offset = [s - n * SHIFT for s in sums]
    y = x - SHIFT
    if max(n * int(np.abs(y).max(initial=0)), *map(abs, offset), 0) >= 1 << 61:
        wide = n * y.astype(object) - np.array(offset, dtype=object)
        return [t if t < 1 << 63 else None for t in (wide * wide).sum(1).tolist()]
    w = n * y - np.array(offset)
    near = (w.astype(np.float64) ** 2).sum(1)  # within a few parts in 10**15
    out: list[int | None] = [None] * len(w)
    sure = near < 9.2e18
    for i, t in zip(np.flatnonzero(sure).tolist(), (w[sure] ** 2).sum(1).tolist()):
        out[i] = t
    for i in np.flatnonzero(~sure & (near < 9.3e18)).tolist():
        t = sum(v * v for v in w[i].tolist())
        out[i] = t if t < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened, explained): a row per vector and component."""
    def run(batches):
        k = len(model.values)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = entries(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(deviation(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(model.apply(x).ravel()), pa.array(np.tile(model.explained, len(x)))],
                    names=["vec_id", "component", "deviation", "whitened", "explained"])

    if not len(model.values):
        vectors = vectors.where("false")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(
        run, "vec_id long, component int, deviation long, whitened double, explained double")


def whitened_rows(vectors: DataFrame, wanted: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = integers(vectors)
    distinct = fit_list(x)
    model = fit(distinct, wanted) or Whitening(0, [], np.empty(0), np.empty((0, 0)), np.empty(0))
    error = identity_error(distinct, model)
    return whiten(x, model).withColumns({"n": F.lit(model.n).cast("long"), "identity_error": F.lit(error)})


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every usable row of embeddings."""
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
