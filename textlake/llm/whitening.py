"""Embedding whitening by mixed-precision eigenvectors.

Every entry c of a vector becomes the integer x = floor(64 c) + 1000000.  Sums are
exact integers.  The covariance is summed by tasks from centred integers
y = x - m (m: the nearest integers to the means), so tasks' sums are exact up to
2**53 and don't depend on the partitions; what the rounding of the means leaves
(less than half a unit) is corrected in extended precision.

The eigenvectors of the d x d covariance are taken in float32 and corrected in
extended precision by Ogita-Aishima steps, which are matrix products only (each made of
exact float64 products of slices and summed in ``numpy.longdouble``): X := X + X E with

    R = I - X'X,  S = X'VX,  l_i = S_ii / (1 - R_ii),
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i)   where |l_i - l_j| is clear of the error,
    E_ij = R_ij / 2                          elsewhere.

A cluster of eigenvalues that are too close for that gets a sub-solve: the
covariance shifted by the cluster's middle, seen through the cluster's vectors,
is a small matrix with its own eigenvectors, which are scaled, solved and
refined in the same way and turn the cluster's vectors.

Only d x d numbers (d: dimension, not rows) reach the driver and go back to the
tasks; ``max_dimension`` bounds them.

Defined results: vectors that are null or hold null or non-finite entries take no
part, nor do vectors with an entry beyond 2**40 / 64 and vectors whose length is
not the commonest one (of equally common, the longest).  Components whose
eigenvalue is zero to working precision (constant or dependent dimensions, a single row)
have no whitened value and are left out; if none is left, there are no rows.
Null ids are kept, repeated rows count each, other columns play no part.
``deviation`` is null where it exceeds 64 bits.  The signs of components are
fixed: the entry of largest magnitude is positive.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
MAX_DIMENSION = 4096
SCALE, SHIFT = 64, 1_000_000
_LIMIT = 2.0 ** 40 / SCALE
_WIDE = np.longdouble


class Whitening(NamedTuple):
    """Sums of the fit list and its leading components (columns of ``vectors``)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: Column, dimension: int | None = None) -> Column:
    """Whether a vector takes part."""
    c = F.transform(vector, lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(c, lambda v: F.coalesce(F.abs(v) <= _LIMIT, F.lit(False))), F.lit(False))
    return fine if dimension is None else fine & (F.size(vector) == dimension)


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """The batch's vectors as integers x, one row each."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, d) * SCALE).astype(np.int64) + SHIFT


def dimension_of(vectors: DataFrame, vector: str = "embedding") -> int:
    """The commonest length of the usable vectors; 0 if there are none."""
    sizes = (vectors.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("d")).first())
    return int(sizes["d"]) if sizes else 0


def covariance(vectors: DataFrame, d: int, vector: str = "embedding") -> tuple[int, list[int], np.ndarray]:
    """Rows, exact sums and covariance (extended precision) of the usable vectors."""
    data = vectors.filter(usable(F.col(vector), d)).select(vector)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b, 0, d)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array(total), pa.array([n] * d)], ["i", "s", "n"])

    rows = (data.mapInArrow(sums, "i long, s long, n long").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect())     # d rows
    if not rows:
        return 0, [0] * d, np.zeros((d, d), _WIDE)
    n = int(rows[0]["n"])
    total = [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre, upper = np.array(middle, np.int64), np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, some = np.zeros((d, d)), False
        for b in batches:
            y = (_matrix(b, 0, d) - centre).astype(np.float64)
            g, some = g + y.T @ y, some or len(y) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(g[upper])], ["k", "g"])

    cells = data.mapInArrow(products, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()  # d (d + 1) / 2 rows
    g = np.zeros((d, d), _WIDE)
    k = np.array([r["k"] for r in cells])
    g[upper[0][k], upper[1][k]] = [r["g"] for r in cells]
    g = np.triu(g) + np.triu(g, 1).T
    # the mean minus its nearest integer, from exact integers
    rest = np.array([_WIDE(s - n * m) / _WIDE(n) for s, m in zip(total, middle)], _WIDE)
    return n, total, g / _WIDE(n) - np.outer(rest, rest)


def _slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of float64 matrices whose entries are multiples, of ``bits`` bits
    at most, of a power of two for the row (axis 1) or column (axis 0)."""
    top = np.abs(a).max(axis=axis, keepdims=True, initial=0)
    unit = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1)))), 1)
    out = []
    for _ in range(3):
        unit = unit / _WIDE(2.0 ** bits)
        part = np.rint(a / unit) * unit
        out.append(part.astype(np.float64))
        a = a - part
    return out


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in extended precision from float64 products that are exact: slices
    short enough for their sums of products to fit 53 bits."""
    bits = (53 - max(1, a.shape[1] - 1).bit_length()) // 2 - 1
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    out = np.zeros((a.shape[0], b.shape[1]), _WIDE)
    for k in (2, 1, 0):                                # small terms first
        for i in range(k, -1, -1):
            out += left[i] @ right[k - i]
    return out


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Newton-Schulz steps: columns orthonormal to working precision (they nearly are)."""
    for _ in range(4):
        r = np.eye(x.shape[1], dtype=_WIDE) - _mul(x.T, x)
        x = x + _mul(x, r) / 2
        if np.abs(r).max(initial=0) < 1e-17:
            break
    return x


def _runs(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of values that chain together with gaps of at most ``gap``."""
    order = np.argsort(-values)
    cuts = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine(a: np.ndarray, start: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from near ones: Ogita-Aishima
    steps in extended precision until they change nothing more, sub-solves for clusters.

    A correction is only trusted while it is small; pairs of values that are closer
    than the present error are a cluster and are turned by their own small solve."""
    x = _orthonormal(start.astype(_WIDE))
    scale = np.abs(a).sum(axis=1).max(initial=0)
    for _ in range(steps):
        eye = np.eye(x.shape[1], dtype=_WIDE)
        r, s = eye - _mul(x.T, x), _mul(x.T, _mul(a, x))
        lam = np.diag(s) / (1 - np.diag(r))
        off = np.sqrt(((s - np.diag(np.diag(s))) ** 2).sum()) + scale * np.sqrt((r ** 2).sum())
        near = np.abs(lam[:, None] - lam[None, :]) <= 2 * off
        gap = np.where(near, 1, lam[None, :] - lam[:, None])
        e = np.where(near, r / 2, (s + lam[None, :] * r) / gap)
        x = x + _mul(x, e)
        for c in _runs(lam, float(2 * off)):
            x[:, c] = _mul(x[:, c], _sub_solve(a, x[:, c], lam[c]))
        x = _orthonormal(x)
        if np.abs(e - np.diag(np.diag(e))).max(initial=0) < 1e-18 and not _runs(lam, float(2 * off)):
            break
        if off <= 1e-18 * scale:
            break
    lam = np.diag(_mul(x.T, _mul(a, x)))
    order = np.argsort(-lam, kind="stable")
    return lam[order], x[:, order]


def _sub_solve(a: np.ndarray, v: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Turn of a cluster's vectors: eigenvectors of (a - middle) seen through them.

    The shift takes the common part away, so what float64 resolves is relative to
    the width of the cluster and not to its place."""
    mid = lam.mean()
    v = _orthonormal(v)
    small = _mul(v.T, _mul(a, v) - mid * v)
    small = (small + small.T) / 2
    width = np.abs(small).max(initial=0)
    if width == 0:
        return np.eye(v.shape[1], dtype=_WIDE)
    _, turn = np.linalg.eigh((small / width).astype(np.float64))
    turn = _orthonormal(turn.astype(_WIDE))
    for _ in range(3):                                  # the same steps on the scaled small matrix
        s = _mul(turn.T, _mul(small / width, turn))
        r = np.eye(len(s), dtype=_WIDE) - _mul(turn.T, turn)
        lam_s = np.diag(s) / (1 - np.diag(r))
        gap = lam_s[None, :] - lam_s[:, None]
        clear = np.abs(gap) > 1e-12
        e = np.where(clear, (s + lam_s[None, :] * r) / np.where(clear, gap, 1), r / 2)
        turn = _orthonormal(turn + _mul(turn, e))
    return turn


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and unit eigenvectors of a covariance."""
    scale = np.abs(cov).max(initial=0)
    if scale == 0:
        return np.zeros(len(cov), _WIDE), np.eye(len(cov), dtype=_WIDE)
    _, first = np.linalg.eigh((cov / scale).astype(np.float32))
    values, x = refine(cov / scale, first)
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)
    return values * scale, x / np.sqrt((x * x).sum(axis=0))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
        max_dimension: int = MAX_DIMENSION) -> Whitening:
    """Mean and leading components of all usable vectors."""
    d = dimension_of(vectors, vector)
    if d > max_dimension:
        raise ValueError(f"{d} dimensions: the d x d covariance is solved on the driver, up to {max_dimension}")
    if d == 0:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums, cov = covariance(vectors, d, vector)
    values, x = eigen(cov)
    kept = values > values[0] * d * 1e-15 if n and values[0] > 0 else np.zeros(d, bool)
    k = min(components, int(kept.sum()))
    return Whitening(n, sums, values[:k].astype(np.float64), x[:, :k].astype(np.float64), float(np.trace(cov)))


def transform(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Id, exact ``deviation`` from the mean and the array ``whitened`` of every usable vector."""
    d, k = len(w.sums), len(w.values)
    data = vectors.filter(usable(F.col(vector), d)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    n, turn = w.n, w.vectors / np.sqrt(w.values) if k else np.zeros((d, 0))
    middle = [(2 * s + n) // (2 * n) for s in w.sums] if n else []
    rest = [s - n * m for s, m in zip(w.sums, middle)]          # sums minus n times the nearest integer, exact
    mid, left = np.array(middle, np.int64), np.array(rest, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = _matrix(b, 1, d) - mid
            z = (y - left / n) @ turn
            rough = np.abs(y).max(initial=0) * float(n) + n
            if rough * rough * d < 2.0 ** 62:
                dev = ((y * n - left) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
                dev = [v if v < 1 << 63 else None for v in exact]
            flat = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), flat], ["id", "deviation", "whitened"])

    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(rows, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    upper = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s, some = np.zeros((k, k)), np.zeros(k), False
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            g, s, some = g + z.T @ z, s + z.sum(axis=0), some or len(z) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + k)), pa.array(np.concatenate([g[upper], s]))], ["k", "g"])

    cells = whitened.select("whitened").mapInArrow(products, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()
    flat = np.zeros(len(upper[0]) + k)
    flat[[r["k"] for r in cells]] = [r["g"] for r in cells]
    mean = flat[len(upper[0]):] / n                    # zero but for rounding: the values are centred
    cov = flat[:len(upper[0])] / n - mean[upper[0]] * mean[upper[1]]
    return float(np.abs(cov - (upper[0] == upper[1])).max(initial=0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``n``, ``deviation``, ``whitened``,
    ``explained`` (share of the variance) and ``identity_error`` (of the whole result)."""
    w = fit(vectors, vector, components)
    k = len(w.values)
    spark = vectors.sparkSession
    if not k:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double").withColumnRenamed("id", id_col)
    rows = transform(vectors, w, id_col, vector)
    error = identity_error(rows, w.n, k)
    shares = F.array(*(F.lit(float(v) / w.trace) for v in w.values))
    return (rows.select("id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("p") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(shares, F.col("p")).alias("explained"), F.lit(error).alias("identity_error")))
