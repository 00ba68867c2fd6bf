"""Whitening of embeddings by singular values of a bidiagonal matrix.

Centred rows are reduced to a triangle by QR, block by block within a task and triangle by triangle
between tasks. Householder reflections make the triangle bidiagonal, the differential quotient
difference algorithm with shifts finds the squares of its singular values, and twisted
factorisations of the shifted product give the directions. Only the triangle, of a size that the
dimension fixes, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.lineage import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Quantised components below this are exact as doubles.
LARGEST = 2.0**53
#: Sums are taken of halves of so many bits, so that no sum of longs overflows.
HALF = 26
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
#: Singular values below this share of the largest, times the dimension, count as zero.
NOISE = 4 * EPS
#: Eigenvalues closer than this share of the largest get directions that are made orthogonal.
CLOSE = 1e-3
#: Groups of triangles in the first step of the reduction.
SLOTS = 64


# --- the solver: numpy on one triangle ---------------------------------------------------------


def bidiagonal(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U.T @ triangle @ V``, and ``V``, by Householder reflections."""
    a = triangle.copy()
    d = a.shape[1]
    right = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = float(np.linalg.norm(x))
        v = x.copy()
        if norm == 0.0:
            return v, 0.0
        v[0] += np.copysign(norm, x[0])
        return v, 2.0 / float(v @ v)

    for k in range(d):
        v, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform; None if the shift was beyond the least eigenvalue."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0.0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B.T @ B``, largest first, by dqds with deflation and splitting."""
    found: list[float] = []
    waiting = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while waiting:
        q, e, total = waiting.pop()
        for _ in range(200 * len(q) + 200):
            if len(q) <= 1:
                break
            if q[0] < q[-1]:  # the small end goes last, where it deflates
                q, e = q[::-1], e[::-1]
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1])) or e[i] < TINY), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], total))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # least eigenvalue of the last two rows bounds the least one from above
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            middle = (a + c) / 2
            shift = max(0.0, (a * c - b) / (middle + np.sqrt(max(middle * middle - (a * c - b), 0.0))) if middle else 0.0)
            step = None
            for attempt in (shift, shift * (1 - 1e-6), shift * 0.75, shift * 0.25, 0.0):
                step = _sweep(q, e, attempt)
                if step is not None:
                    total += attempt
                    break
            q, e = step
        else:
            raise ArithmeticError("singular values did not converge")
        found += [total + x for x in q]
    return np.sort(np.array(found))[::-1]


def _safe(x: float, scale: float) -> float:
    return x if abs(x) > TINY else scale * EPS * EPS + TINY


def twisted(a: np.ndarray, b: np.ndarray, value: float, scale: float) -> np.ndarray:
    """Unit eigenvector of ``B.T @ B`` for an eigenvalue, from its twisted factorisation.

    The factorisation from the top and the one from the bottom meet where the remaining pivot is
    smallest; the vector solves the two triangles away from there.
    """
    n = len(a)
    down, up = np.zeros(n), np.zeros(n)
    lower, upper = np.zeros(n - 1), np.zeros(n - 1)
    s = -value
    for i in range(n - 1):
        down[i] = s
        pivot = _safe(s + a[i] ** 2, scale)
        lower[i] = a[i] * b[i] / pivot
        s = b[i] ** 2 * s / pivot - value
    down[n - 1] = s
    p = a[n - 1] ** 2 - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = p
        pivot = _safe(b[i] ** 2 + p, scale)
        upper[i] = a[i] * b[i] / pivot
        p = p * a[i] ** 2 / pivot - value
    up[0] = p
    r = int(np.argmin(np.abs(down + up + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of ``B.T @ B`` for the given largest eigenvalues, as columns."""
    scale = float(max(np.max(a**2, initial=0.0), np.max(b**2, initial=0.0)))
    ends = np.flatnonzero(b**2 <= EPS * EPS * scale)  # parts that do not touch each other
    edges = [0, *(int(x) + 1 for x in ends), len(a)]
    parts = [(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo]
    own = [(lo, hi, squared_singular_values(a[lo:hi], b[lo : hi - 1])) for lo, hi in parts]
    ranked = sorted(((-v, lo, hi) for lo, hi, vs in own for v in vs))[: len(values)]
    out: list[np.ndarray] = []
    rng = np.random.default_rng(13)
    for minus, lo, hi in ranked:
        z = np.zeros(len(a))
        z[lo:hi] = twisted(a[lo:hi], b[lo : hi - 1], -minus, scale)
        near = [o for o, (other, *_) in zip(out, ranked, strict=False) if abs(other - minus) <= CLOSE * scale]
        z = _apart(z, near)
        for _ in range(20):
            if np.linalg.norm(z) > 0.1:
                break
            # as good as equal eigenvalues: inverse iteration from elsewhere in the eigenspace
            start = np.zeros(len(a))
            start[lo:hi] = rng.normal(size=hi - lo)
            z = start = _apart(start, near)
            matrix = np.diag(a[lo:hi] ** 2 + np.r_[0.0, b[lo : hi - 1] ** 2]) + minus * (1 + 4 * EPS) * np.eye(hi - lo)
            off = a[lo : hi - 1] * b[lo : hi - 1]
            matrix += np.diag(off, 1) + np.diag(off, -1)
            for _ in range(3):
                z[lo:hi] = np.linalg.lstsq(matrix, z[lo:hi], rcond=EPS * EPS)[0]
                z = _apart(z / np.linalg.norm(z), near)
        out.append(z / np.linalg.norm(z))
    return np.stack(out, axis=1) if out else np.zeros((len(a), 0))


class Fit(NamedTuple):
    """``n`` distinct vectors with sums ``sums``; eigenvalues of their covariance and directions."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def solved(triangle: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to ``k`` largest eigenvalues of the covariance, their directions, and its trace."""
    size = float(np.max(np.abs(triangle), initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((triangle.shape[1], 0)), 0.0
    a, b, right = bidiagonal(triangle / size)
    every = squared_singular_values(a, b)
    real = every > every[0] * (NOISE * max(len(a), 16)) ** 2
    values = every[real][:k]
    return values * size * size / n, right @ directions(a, b, values), float(every.sum()) * size * size / n


# --- Spark ------------------------------------------------------------------------------------


def quantised(vector: Column) -> Column:
    """``floor(SCALE * c)`` of each component as long; null for vectors that take no part.

    Those are null ones and ones with a null or non-finite component. A component whose multiple
    reaches ``LARGEST`` raises an error, because it would not be exact.
    """
    real = vector.cast("array<double>")
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: x * F.lit(float(SCALE))
    checked = lambda x: F.when(F.abs(scaled(x)) < F.lit(LARGEST), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is too large to quantise exactly")).cast("bigint"))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(real, checked))


def grid(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: as longs where they fit, else as Python integers."""
    most = max([abs(s) for s in sums], default=0) + n * int(np.abs(x).max(initial=0))
    if most < 2**63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(deviation: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row; raises if one does not fit into a long."""
    if deviation.dtype != object:
        most = int(np.abs(deviation).max(initial=0))
        if most * most * deviation.shape[1] < 2**63:
            return (deviation * deviation).sum(axis=1)
        deviation = deviation.astype(object)
    total = (deviation * deviation).sum(axis=1)
    if len(total) and max(total) >= 2**63:
        raise OverflowError("a vector's squared deviation does not fit into a long")
    return total.astype(np.int64)


def sums_of(partials: DataFrame, *names: str) -> dict[str, list]:
    """Element-wise sums of equally long arrays over all rows, added by Spark."""
    at = partials.select(F.posexplode(F.arrays_zip(*names)).alias("at", "v"))
    rows = at.groupBy("at").agg(*[F.sum(f"v.{c}").alias(c) for c in names]).orderBy("at").collect()
    return {c: [r[c] for r in rows] for c in names}


def counted(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension of ``x``; one partial sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d + 1, np.int64), np.zeros(d + 1, np.int64)
        for batch in batches:
            x = grid(batch.column(0), d)
            low[d] += len(x)  # the last place counts rows
            high[:d] += (x >> HALF).sum(axis=0)
            low[:d] += (x & ((1 << HALF) - 1)).sum(axis=0)
        if low[d]:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (high, low)], ["high", "low"])

    total = sums_of(vectors.select("x").mapInArrow(run, "high array<bigint>, low array<bigint>"), "high", "low")
    sums = [(h << HALF) + low for h, low in zip(total["high"], total["low"], strict=True)]
    return (sums[-1], sums[:-1]) if sums else (0, [])


def triangle_of(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows of ``x``.

    A task folds its batches into one triangle of ``d`` rows. Triangles are folded in groups and
    the groups' triangles once more.
    """

    def fold(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([held, rows]), mode="r")
        return np.vstack([r, np.zeros((max(0, d - len(r)), d))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = np.zeros((d, d)), False
        for batch in batches:
            x = grid(batch.column(0), d)
            for at in range(0, len(x), max(4 * d, 1024)):
                some = True
                held = fold(held, deviations(x[at : at + max(4 * d, 1024)], n, sums).astype(float) / n)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()])], ["r"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((d, d))
        for r in frame["r"]:
            held = fold(held, np.asarray(r).reshape(d, d))
        return pd.DataFrame({"r": [held.ravel()]})

    parts = vectors.select("x").mapInArrow(run, "r array<double>")
    slots = F.pmod(F.xxhash64("r"), F.lit(SLOTS).cast("bigint"))
    groups = parts.withColumn("slot", slots).groupBy("slot").applyInPandas(join, "r array<double>")
    last = groups.withColumn("slot", F.lit(0)).groupBy("slot").applyInPandas(join, "r array<double>").collect()
    return np.array(last[0]["r"]).reshape(d, d)


def whitened_rows(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared deviations, and the whitened coordinates, of quantised rows."""
    apart = deviations(x, fit.n, fit.sums)
    return squares(apart), (apart.astype(float) / fit.n) @ fit.vectors / np.sqrt(fit.values)


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured on its rows."""
    d, k = fit.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = (deviations(grid(batch.column(0), d), fit.n, fit.sums).astype(float) / fit.n) @ fit.vectors / np.sqrt(fit.values)
            total += np.r_[w.sum(axis=0), (w.T @ w).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    total = np.array(sums_of(vectors.select("x").mapInArrow(run, "v array<double>"), "v")["v"]) / fit.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fitted(vectors: DataFrame, d: int, k: int) -> Fit | None:
    """Model of distinct vectors ``x`` of ``d`` components; None if they do not differ."""
    n, sums = counted(vectors, d)
    if n < 2:
        return None
    values, directions_, trace = solved(triangle_of(vectors, d, n, sums), n, k)
    return Fit(n, sums, values, directions_, trace) if len(values) else None


def whiten(table: DataFrame, vector: str = "embedding", identifier: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector along the ``k`` directions of largest variance.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each
    component of each row that takes part, repeated rows and null ids included. Rows with a null
    vector or a null or non-finite component take no part. The fit uses each distinct quantised
    vector once. Vectors shorter than the longest count as ending in zeros. Directions without
    variance (beyond the rank, to rounding) give no rows, so equal vectors, a single one or an empty
    table give none. Equal eigenvalues give some orthogonal directions of their space. A component
    too large to be exact, or a squared deviation that does not fit into a long, raises an error.
    Other columns are not read. The dimension must allow a square matrix of it in a task.
    """
    spark = table.sparkSession
    kind = table.schema[identifier].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = table.select(F.col(identifier).alias("vec_id"), quantised(F.col(vector)).alias("x")).where("x is not null")
    d, least = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if not d:
        return spark.createDataFrame([], shape)
    if least < d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("x"))))
    distinct = cut_lineage(rows.select("x").distinct())
    fit = fitted(distinct, d, k)
    if fit is None:
        return spark.createDataFrame([], shape)
    error = identity_error(distinct, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, white = whitened_rows(grid(batch.column(1), d), fit)
            rows, found = white.shape
            of = np.repeat(np.arange(rows), found)
            columns = [
                batch.column(0).take(pa.array(of)),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * found, fit.n, np.int64)),
                pa.array(deviation[of]),
                pa.array(white.ravel()),
                pa.array(np.tile(fit.values / fit.trace, rows)),
                pa.array(np.full(rows * found, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, shape)
