"""PCA whitening of embeddings: exact integer covariance in Spark, eigenvectors refined from single to extended precision.

1. Entries become integers ``x = floor(scale * c) + shift``. One pass sums them by dimension (n and S), a second pass adds products of centred
   rows: ``y = x - round(S / n)``, so all entries are centred before they are multiplied. A task turns its batches into integer-valued float64 matrix
   products that stay below 2**53 (entries are cut into limbs where they are large), keeps one d x d matrix of whole numbers, and the matrices
   are added by an aggregate over positions. What reaches the driver is d * (d + 1) / 2 numbers, whatever the number of rows, and it is exact, however Spark cut the data.
2. The covariance ``n * sum(y y') - s s'`` (over n * n, s the sums of y) is formed in whole numbers and rounded once.
3. Eigenvectors: a float32 decomposition is the start. Ogita-Aishima steps correct it with matrix products in extended precision: with
   ``R = I - X'X`` and ``S = X'AX``, each pair gets ``(s_ij + l_j r_ij) / (l_j - l_i)``, and X grows by X times that. Pairs whose eigenvalues are nearer than the
   step's error bound form clusters; those get ``r_ij / 2`` only, and each cluster is rotated by a sub-solve of its shifted, small matrix,
   whose gaps are then large against its norm. Steps end when corrections vanish.
4. A last pass projects every row; its results are read again to measure the covariance of the whitened values.

Defined cases. Rows with a null vector, or with a null or non-finite entry, or one beyond 2**40, are dropped. Shorter vectors count as filled up with zeros. Repeated ids and rows
count as often as they occur. ``deviation`` is null where it exceeds 64 bits. A component without variance (an eigenvalue below 1e-12 of the trace) has a null
``whitened`` and takes no part in ``identity_error``. No rows, or no entries in any: an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

LIMIT = float(2**40)
LIMB = 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that remain; ``v`` keeps its stored type."""
    v = F.col(vector_col)
    if not isinstance(vectors.schema[vector_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(LIMIT)))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def whole(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """The integer rows of a batch, filled up to ``width``."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(scale * out).astype(np.int64) + shift


def parts(batches: Iterator[pa.RecordBatch], width: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a matrix of their rows holds about ``most`` entries."""
    step = max(1, most // max(1, width))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` of an integer matrix, exactly, as Python integers."""
    n, d = y.shape
    top = int(np.abs(y).max(initial=0))
    if top * top * max(n, 1) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, total = [], np.zeros((d, d), object)
    while True:  # the last limb keeps the sign
        low = y & ((1 << LIMB) - 1)
        limbs.append(low.astype(np.float64))
        y = y >> LIMB
        if ((y == 0) | (y == -1)).all():
            limbs.append(y.astype(np.float64))
            break
    step = 4096  # products of limbs stay below 2**53
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for k in range(0, n, step):
                total += (a[k : k + step].T @ b[k : k + step]).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def moments(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int], np.ndarray]:
    """``(n, S, G)``: rows, sums of x by dimension, and the exact product matrix of ``x - round(S / n)``."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in parts(batches, width):
            x = whole(batch.column(0), width, scale, shift)
            n += len(x)
            total = total + np.array([int(c) for c in (x >> 32).sum(0)], object) * 2**32 + (x & (2**32 - 1)).sum(0).astype(object)
        # As two halves: sums of whole numbers in Spark stay exact and in range.
        told = [(-1, 0, n), *((i, int(s) >> 32, int(s) & (2**32 - 1)) for i, s in enumerate(total))]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in told], pa.int64()) for k in range(3)], ["at", "high", "low"])

    found = rows.select("v").mapInArrow(sums, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    by = {r["at"]: (r["high"] << 32) + r["low"] for r in found}
    n = by.get(-1, 0)
    s = [by.get(i, 0) for i in range(width)]
    if not n:
        return 0, s, np.zeros((width, width), object)
    centre = centres(n, s)
    mid, upper = np.array(centre, np.int64), np.triu_indices(width)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in parts(batches, width):
            total = total + exact_gram(whole(batch.column(0), width, scale, shift) - mid)
        flat = [int(g) for g in total[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int64()), *(pa.array([(g >> s) & (2**32 - 1) if s < 96 else g >> s for g in flat], pa.int64()) for s in (0, 32, 64, 96))], ["at", "a", "b", "c", "d"])

    found = rows.select("v").mapInArrow(grams, "at long, a long, b long, c long, d long").groupBy("at").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
    gram = np.zeros((width, width), object)
    for r in found:
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        gram[i, j] = gram[j, i] = r["a"] + (r["b"] << 32) + (r["c"] << 64) + (r["d"] << 96)
    return n, s, gram


def centres(n: int, s: list[int]) -> list[int]:
    """Whole numbers next to the means."""
    return [(2 * t + n) // (2 * n) for t in s]


def covariance(n: int, s: list[int], gram: np.ndarray) -> np.ndarray:
    """The covariance with divisor n in extended precision, rounded once from whole numbers."""
    rest = np.array([t - n * c for t, c in zip(s, centres(n, s))], object)
    top = n * gram - rest[:, None] * rest[None, :]
    square = n * n

    def ratio(t: int) -> np.longdouble:
        whole, part = divmod(int(t), square)
        return np.longdouble(whole) + np.longdouble((part << 70) // square) / np.longdouble(2) ** 70

    return np.array([[ratio(t) for t in row] for row in top], np.longdouble).reshape(top.shape)


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of eigenvalues (in order) in which each is within ``near`` of the next."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of the symmetric ``a``, from a float32 start; see the module."""
    a = a.astype(np.longdouble)
    d = len(a)
    norm = np.sqrt((a * a).sum()) or np.longdouble(1)
    _, start = np.linalg.eigh((a / norm).astype(np.float32))
    x, one = start.astype(np.longdouble), np.eye(d, dtype=np.longdouble)
    tiny, turned = np.finfo(np.longdouble).eps, 1.0
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # equal halves, so that the corrections of a close pair cancel in X'X
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        if turned <= 1e3 * tiny and np.abs(off).max() <= 64 * tiny * norm and np.abs(r).max() <= 64 * tiny:
            break
        bound = 2 * (np.linalg.norm(off.astype(np.float64)) + float(norm) * np.linalg.norm(r.astype(np.float64)))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > bound
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        # Within a cluster the directions are free as far as this step can tell: a sub-solve of the shifted small matrix parts them.
        turned = 0.0
        for group in _clusters(value, bound):
            own = x[:, group]
            middle = value[group].mean()
            inner = own.T @ (a @ own - middle * own)
            inner = (inner + inner.T) / 2
            size = np.abs(inner).max()
            if size > 0:
                level, turn = np.linalg.eigh((inner / size).astype(np.float64))
                if np.abs(inner / size - np.diag(np.diag(inner / size))).max() > 8 * tiny * float(norm / size) * d:
                    x[:, group] = own @ turn.astype(np.longdouble)
                    turned = max(turned, float(size / norm))
    x = x @ (one + (one - x.T @ x) / 2)  # unit length again after the last rotations
    value = np.diag(x.T @ (a @ x))
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    rows = usable(vectors)
    n, s, gram = moments(rows, scale, shift)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if not n or not len(s):
        return vectors.sparkSession.createDataFrame([], f"{shape}, identity_error double")
    cov = covariance(n, s, gram)
    values, axes = refined(cov)
    trace, width = np.trace(cov), len(s)
    top = min(components, width)
    live = [k for k in range(top) if values[k] > 1e-12 * trace and trace > 0]
    scaled = (axes[:, live] / np.sqrt(values[live])).astype(np.float64)
    explained = [float(values[k] / trace) if trace > 0 else 0.0 for k in range(top)]
    centre = centres(n, s)
    mid = np.array(centre, np.int64)
    rest = np.array([t - n * c for t, c in zip(s, centre)], object)
    off = np.array([float(r) / n for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, width):
            y = whole(batch.column(1), width, scale, shift) - mid
            w = np.full((len(y), top), np.nan)
            w[:, live] = (y - off) @ scaled
            far = (int(np.abs(y).max(initial=0)) + 1) * n
            if far * far * width < 2**63:
                dev = [int(t) for t in ((n * y - rest.astype(np.int64)) ** 2).sum(1)]
            else:
                dev = [int(t) if t < 2**63 else None for t in ((n * y.astype(object) - rest) ** 2).sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dev, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), top).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    done = materialize(rows.select("vec_id", "v").mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    # One row of sums: the whitened values are centred at zero already, so their means only correct rounding.
    pairs = [(i, j) for k, i in enumerate(live) for j in live[k:]]
    sums = done.agg(*(F.avg(F.col("w")[i] * F.col("w")[j]).alias(f"p{i}_{j}") for i, j in pairs), *(F.avg(F.col("w")[i]).alias(f"m{i}") for i in live)).first() if live else None
    error = max((abs(sums[f"p{i}_{j}"] - sums[f"m{i}"] * sums[f"m{j}"] - (i == j)) for i, j in pairs), default=0.0)
    out = done.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation")
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    value = F.when(F.isnan("whitened"), None).otherwise(F.col("whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", value.alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))
