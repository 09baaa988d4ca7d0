"""Whitening of embeddings by leading principal components.

Sums and the centred covariance of the distinct vectors are added up in Spark, a
d x d matrix a task. The driver takes that one matrix: Householder reflections
make it tridiagonal, Sturm counts bisect for the leading eigenvalues, and inverse
iteration gives their vectors (those of a cluster are made orthogonal to each
other), which are reflected back and broadcast for the projection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import written
from lodestar.llm.vectors import integers, matrix

#: components, and tasks whose matrices are added up at once
COMPONENTS, FAN = 4, 64
EPS = np.finfo(float).eps


# ---- the eigenproblem of one symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the Householder vectors that bring ``a`` there."""
    a, reflect = a.copy(), []
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k]
        u = x.copy()
        u[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(u)
        u = u / size if size else u
        reflect.append(u)
        # P A P with P = 1 - 2 u u'
        block = a[k + 1:, k + 1:]
        p = block @ u
        w = 2 * (p - (u @ p) * u)
        block -= np.outer(u, w) + np.outer(w, u)
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(d - 1)]), reflect


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``: negative pivots of T - x (a Sturm count)."""
    small = EPS * (np.abs(off).max(initial=0) + np.abs(diagonal).max() + np.finfo(float).tiny)
    q = diagonal[0] - x
    n = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < small, -small, q)
        q = diagonal[i] - x - off[i - 1] ** 2 / q
        n += q < 0
    return n


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, by bisection until no number lies between the ends."""
    d = len(diagonal)
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    lo = np.full(k, (diagonal - radius).min())
    hi = np.full(k, (diagonal + radius).max())
    hi = hi + np.abs(hi) * 4 * EPS + np.finfo(float).tiny
    want = d - 1 - np.arange(k)  # as many lie below the eigenvalue
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        over = below(diagonal, off, mid) > want
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, small: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges."""
    n = len(diagonal)
    a, u, v, b = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(a[i]):  # exchange rows i and i + 1
            a[i], low[i] = low[i], a[i]
            u[i], a[i + 1] = a[i + 1], u[i]
            if i + 1 < n - 1:
                v[i], u[i + 1] = u[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(a[i]) < small:
            a[i] = math.copysign(small, a[i])
        f = low[i] / a[i]
        a[i + 1] -= f * u[i]
        if i + 1 < n - 1:
            u[i + 1] -= f * v[i]
        b[i + 1] -= f * b[i]
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        p = a[i] if abs(a[i]) >= small else math.copysign(small, a[i])
        x[i] = (b[i] - u[i] * x[i + 1] - v[i] * x[i + 2]) / p
    return np.array(x[:n])


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; those of values close together are kept orthogonal."""
    d = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    out: list[np.ndarray] = []
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * scale:
            start = j
        # equal values are told apart by a last digit or so, that the systems differ
        shift = value - (j - start) * 4 * EPS * scale
        x = np.random.default_rng(j).standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                for v in out[start:]:
                    x -= (v @ x) * v
            x /= np.linalg.norm(x)
            x = _solve(diagonal, off, shift, x, EPS * scale)
            x /= np.abs(x).max()
        for _ in range(2):
            for v in out[start:]:
                x -= (v @ x) * v
        out.append(x / np.linalg.norm(x))
    return np.array(out).reshape(-1, d)


def principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    scale = np.abs(cov).max(initial=0) or 1.0
    diagonal, off, reflect = tridiagonal(cov / scale)
    values = leading(diagonal, off, k)
    x = eigenvectors(diagonal, off, values)
    for i in range(len(reflect) - 1, -1, -1):
        u = reflect[i]
        x[:, i + 1:] -= 2 * np.outer(x[:, i + 1:] @ u, u)
    return values * scale, x / np.linalg.norm(x, axis=1)[:, None]


# ---- sums over all rows

def _added(rows: DataFrame, kinds: str) -> DataFrame:
    """Sums of equally long arrays ``x`` by ``i``: of FAN tasks at a time, then of these. Added in the order of the tasks."""
    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("task").combine_chunks()
        x = part["x"].combine_chunks()
        total = x.flatten().to_numpy().reshape(len(x), -1).sum(axis=0)
        return pa.table({"task": part["task"].slice(0, 1), "i": part["i"].slice(0, 1), "x": pa.array([total], x.type)})

    first = rows.withColumn("fan", F.expr(f"task div {FAN}")).groupBy("fan", "i").applyInArrow(add, kinds)
    return first.groupBy("i").applyInArrow(add, kinds)


def sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows of ``fit`` (v), and the whole-number sum of each dimension."""
    def add(batches):
        total = np.zeros(d + 1, np.int64)
        for b in batches:
            total[:d] += matrix(b.column("v"), d).astype(np.int64).sum(axis=0)
            total[d] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, TaskContext.get().partitionId()), pa.int64()), pa.array(np.arange(d + 1)),
                                          pa.array(total)], ["task", "i", "x"])
    got = fit.select("v").mapInArrow(add, "task long, i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
    by = {r["i"]: r["x"] for r in got}
    return by.get(d, 0), np.array([by.get(i, 0) for i in range(d)], object)


def covariance(fit: DataFrame, d: int, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum of the products of centred rows of ``fit`` (of their coordinates in ``basis``, rows, if given)."""
    def add(batches):
        k = d if basis is None else len(basis)
        total = np.zeros((k, k))
        for b in batches:
            x = matrix(b.column("v"), d) - mean
            x = x if basis is None else x @ basis.T
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, TaskContext.get().partitionId()), pa.int64()), pa.array(np.arange(k)),
                                          pa.array(list(total), pa.list_(pa.float64()))], ["task", "i", "x"])
    kinds = "task long, i long, x array<double>"
    got = _added(fit.select("v").mapInArrow(add, kinds), kinds).collect()
    out = np.array([r["x"] for r in sorted(got, key=lambda r: r["i"])], np.float64)
    return (out + out.T) / 2


OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(emb: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component up to ``k``.

    The fit is on each distinct vector (of whole numbers) once. Rows are left out if their vector is null or
    a component is null or not finite; a null id stays null; shorter vectors count as ending in zeros. Rows that repeat are
    returned each. A component without variance (as all are with one distinct vector) has null ``whitened``, and
    ``explained`` is null if there is no variance at all; a deviation beyond a long is null. An empty table gives an empty result.
    """
    spark = emb.sparkSession
    v = integers(emb.withColumn("_key", F.lit(0)), "_key", vec_col, own=id_col).select(F.col("own").cast("long").alias("id"), "v")
    d = v.agg(F.max(F.greatest(F.size("v"), F.lit(1)))).first()[0]
    if d is None:
        return spark.createDataFrame([], OUT)
    # vectors that differ in trailing zeros only are equal
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v")))
    fit = written(v.select(padded.alias("v")).distinct(), "whitening-fit")
    n, total = sums(fit, d)
    mean = np.array([float(s) / n for s in total])
    cov = covariance(fit, d, mean) / n
    k = min(k, d)
    values, vectors = principal(cov, k)
    trace = float(np.trace(cov))
    live = values > d * EPS * max(values[0], 0)
    basis = vectors[live] / np.sqrt(values[live])[:, None]
    error = float(np.abs(covariance(fit, d, mean, basis) / n - np.eye(live.sum())).max(initial=0)) if live.any() else 0.0
    explained = [float(x / trace) if trace > 0 else None for x in np.where(live, values, 0.0)]
    shared = spark.sparkContext.broadcast((basis, mean, total, live, explained))  # k x d numbers and a few more

    def project(batches):
        basis, mean, total, live, explained = shared.value
        exact = np.array([int(s) for s in total], object)
        for b in batches:
            x = matrix(b.column("v"), d)
            m = len(x)
            if not m:
                continue
            whitened = np.full((m, len(live)), np.nan)
            whitened[:, live] = (x - mean) @ basis.T
            # whole numbers throughout: longs if the sum of squares surely fits, else numbers of any length
            most = float(n) * float(np.abs(x).max(initial=0)) + float(max(abs(s) for s in exact))
            kind = np.int64 if d * most * most < 2.0 ** 62 else object
            dev = x.astype(np.int64).astype(kind) * n - exact.astype(kind)
            dev = [y if y < 1 << 63 else None for y in (dev * dev).sum(axis=1).tolist()]
            times = np.repeat(np.arange(m), len(live))
            flat = whitened.ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(times)), pa.array(np.tile(np.arange(1, len(live) + 1, dtype=np.int32), m)),
                 pa.array(np.full(len(times), n, np.int64)), pa.array([dev[i] for i in times], pa.int64()),
                 pa.array(flat, mask=np.isnan(flat)), pa.array(explained * m, pa.float64()), pa.array(np.full(len(times), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return v.mapInArrow(project, OUT)
