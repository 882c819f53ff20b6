"""Embedding whitening: compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Vectors become integers (256 times an entry, floored), so counts and sums are exact. Each task adds
centred outer products in double-double (error-free products and sums) and gives one pair of high
and low parts for every block of the triangle; tasks' parts are merged in two shuffles. Only the
d x d covariance comes to the driver, its size is that of one vector's square.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those of
another length than the most frequent one (of equally frequent lengths the longer). Repeated vectors
count once in the fit, and every row of them is whitened. Components without variance (constant
columns, fewer vectors than dimensions) have no direction to scale: ``whitened`` is null for them;
``explained`` and ``identity_error`` are null where nothing varies at all. ``deviation`` is null
where it leaves 64 bits. A null ``vec_id`` stays; an empty table gives none; other columns of the
table are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ravine.llm.common import materialize

#: Components returned.
COMPONENTS = 4
#: Entries of the triangle in one block, and products worked on at once.
BLOCK, AT_ONCE = 4096, 1 << 18
#: Parts into which the tasks' sums of a block are merged first.
SALTS = 32

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and what rounding lost of it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and what rounding lost of it, by splitting each factor in two halves."""
    p = a * b
    x, y = 134217729.0 * a, 134217729.0 * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def fold(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of double-doubles over the first axis, halving it again and again."""
    while len(high) > 1:
        half = len(high) // 2
        h, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = np.concatenate([h, high[2 * half :]]), np.concatenate([e, low[2 * half :]])
    return high[0], low[0]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of lists of d entries as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), d)


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x - mean, in double-double."""
    h, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(h, e - mean[1])


def outer(c: Pair, rows: np.ndarray, cols: np.ndarray) -> Pair:
    """The sum of the vectors' outer products at the triangle's entries."""
    total = np.zeros(len(rows)), np.zeros(len(rows))
    step = max(AT_ONCE // max(len(rows), 1), 1)
    for at in range(0, len(c[0]), step):
        h, e = c[0][at : at + step], c[1][at : at + step]
        p, q = two_product(h[:, rows], h[:, cols])
        total = add(total, fold(p, q + (h[:, rows] * e[:, cols] + e[:, rows] * h[:, cols])))
    return total


PARTS = "block int, salt int, high binary, low binary"


def _part(block: int, salt: int, pair: Pair) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([pair[0].tobytes()]), pa.array([pair[1].tobytes()])], ["block", "salt", "high", "low"])


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Add the parts of equal keys, read one after another: a task keeps one sum for each key."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], Pair] = {}
        for batch in batches:
            for block, salt, high, low in zip(*(batch.column(i).to_pylist() for i in range(4))):
                key, pair = (block, salt if "salt" in keys else 0), (np.frombuffer(high), np.frombuffer(low))
                sums[key] = add(sums[key], pair) if key in sums else pair
        yield from (_part(*key, pair) for key, pair in sums.items())

    return parts.repartition(*keys).mapInArrow(merged, PARTS)


def second_moments(vectors: DataFrame, d: int, mean: Pair) -> Pair:
    """Sums of the outer products of ``vectors`` (one list column) less ``mean``, as a full matrix of
    high and one of low parts."""
    rows, cols = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_ = (np.zeros(len(rows)), np.zeros(len(rows))), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = add(total, outer(centred(matrix(batch.column(0), d), mean), rows, cols)), True
        salt = TaskContext.get().partitionId() % SALTS
        for block in range(-(-len(rows) // BLOCK) if any_ else 0):
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            yield _part(block, salt, (total[0][at], total[1][at]))

    merged = _merge(_merge(vectors.mapInArrow(partial, PARTS), "block", "salt"), "block").collect()  # d * d numbers
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for r in merged:
        at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        for full, part in ((high, r["high"]), (low, r["low"])):
            full[rows[at], cols[at]] = full[cols[at], rows[at]] = np.frombuffer(part)
    return high, low


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: a = q t q', t given by its diagonal and the one beside it."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if not scale or not np.abs(x[1:]).max():
            continue
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - x)) for rising d: the d nearest to each, and the distance.

    Each root lies between two neighbouring d (the last beyond all); bisection from the nearer one
    keeps the distance accurate to its last bits.
    """
    k, width = len(d), np.append(np.diff(d), rho * (z @ z))
    f = lambda origin, x: 1 + rho * ((z * z) / ((d[None, :] - origin[:, None]) - x[:, None])).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = (f(d, width / 2) < 0) & (np.arange(k) < k - 1)
        origin = np.where(right, np.append(d[1:], 0), d)
        low, high = np.where(right, -width / 2, 0.0), np.where(right, 0.0, np.where(np.arange(k) < k - 1, width / 2, width))
        for _ in range(220):
            mid = (low + high) / 2
            below = f(origin, mid) < 0
            low, high = np.where(below, mid, low), np.where(below, high, mid)
    mid = (low + high) / 2
    tiny = np.finfo(float).tiny
    return origin, np.where(mid == 0, np.where(right, -tiny, tiny), mid)


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of a symmetric tridiagonal matrix.

    The matrix is torn into halves and a rank-one update; directions that the update leaves alone,
    and those of equal eigenvalues (turned into each other), are set aside; the others are roots of
    the secular equation, with the update's vector worked out anew from the roots so that the
    eigenvectors are orthogonal.
    """
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, rho, sign = n // 2, abs(e[n // 2 - 1]), np.copysign(1.0, e[n // 2 - 1])
    left, rest = d[:m].copy(), d[m:].copy()
    left[-1] -= rho
    rest[0] -= rho
    (w1, q1), (w2, q2) = divide_and_conquer(left, e[: m - 1]), divide_and_conquer(rest, e[m:])
    w, q = np.concatenate([w1, w2]), np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    z = np.concatenate([q1[-1], sign * q2[0]]) / np.sqrt(2)
    rho *= 2
    order = np.argsort(w, kind="stable")
    w, z, q = w[order], z[order], q[:, order]
    tol = 8 * np.finfo(float).eps * max(np.abs(w).max(), rho)
    live: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) <= tol:
            z[i] = 0
            continue
        if live and (w[i] - w[live[-1]]) * abs(z[i] * z[live[-1]]) <= tol * (r := np.hypot(z[i], z[live[-1]])) * r:
            j = live.pop()
            c, s = z[i] / r, z[j] / r
            q[:, j], q[:, i] = c * q[:, j] - s * q[:, i], s * q[:, j] + c * q[:, i]
            w[j], w[i] = c * c * w[j] + s * s * w[i], s * s * w[j] + c * c * w[i]
            z[j], z[i] = 0, r
        live.append(i)
    if live:
        d2, z2 = w[live], z[live]
        origin, shift = _secular(d2, z2, rho)
        gap = (d2[None, :] - origin[:, None]) - shift[:, None]  # [root, pole]
        ratio = -gap
        for i in range(len(live)):  # pair each root's distance with a pole's so that products stay in range
            others = np.delete(d2, i) - d2[i]
            above = np.delete(ratio[:, i], -1) if i == len(live) - 1 else np.concatenate([ratio[:i, i], ratio[i + 1 :, i]])
            z2[i] = np.copysign(np.sqrt(abs(np.prod(above / others) * (ratio[-1, i] if i == len(live) - 1 else ratio[i, i]) / rho)), z2[i])
        v = z2[None, :] / gap
        v /= np.linalg.norm(v, axis=1)[:, None]
        w[live], q[:, live] = origin + shift, q[:, live] @ v.T
    order = np.argsort(w, kind="stable")
    return w[order], q[:, order]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows.

    The sign is fixed: a vector's largest entry is positive.
    """
    diagonal, beside, q = tridiagonal((v + v.T) / 2)
    w, s = divide_and_conquer(diagonal, beside)
    vectors = (q @ s).T[::-1]
    largest = vectors[np.arange(len(v)), np.abs(vectors).argmax(1)]
    return w[::-1], vectors * np.copysign(1.0, largest)[:, None]


def _double_double(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def as_integers(vector: Column) -> Column:
    """floor(256 * c) of each entry; null where the vector is null, empty or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.when(~bad & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")) + F.lit(0)))


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, whitened array, eigen-structure) of every usable row: see ``whiten_embeddings``."""
    spark = df.sparkSession
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(df.schema[vec_id].dataType.simpleString())
    rows = df.select(F.col(vec_id).alias("vec_id"), as_integers(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length:
        return spark.createDataFrame([], schema)
    d = length["d"]
    rows = rows.filter(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count("*").alias("n")).collect()  # d rows
    n, total = sums[0]["n"], [r["s"] for r in sorted(sums, key=lambda r: r["pos"])]
    mean = tuple(np.array(part) for part in zip(*(_double_double(Fraction(s, n)) for s in total)))
    high, low = second_moments(fit, d, mean)
    v = high / n + low / n
    values, vectors = eigen(v)
    k, trace = min(components, d), float(np.trace(v))
    rank = int((values[:k] > 64 * np.finfo(float).eps * max(values[0], 0) * d).sum()) if trace > 0 else 0
    basis = vectors[:rank] / np.sqrt(values[:rank])[:, None]

    def project(column: pa.Array) -> np.ndarray:
        h, e = centred(matrix(column, d), mean)
        return h @ basis.T + e @ basis.T

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = project(b.column(b.num_columns - 1))
            offsets = pa.array(np.arange(0, len(y) * rank + 1, rank) if rank else np.zeros(len(y) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], b.columns[-1], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], [*b.schema.names, "y"])

    error = None
    if rank:
        with_one = fit.mapInArrow(projected, "x array<bigint>, y array<double>").select(F.concat("y", F.array(F.lit(1.0))).alias("y"))
        high, low = second_moments(with_one, rank + 1, (np.zeros(rank + 1), np.zeros(rank + 1)))
        shift = high[:rank, rank] / n
        error = float(np.abs(high[:rank, :rank] / n + low[:rank, :rank] / n - np.outer(shift, shift) - np.eye(rank)).max())
    name = df.schema[vec_id].dataType.simpleString()
    out = rows.mapInArrow(projected, f"vec_id {name}, x array<bigint>, y array<double>")
    times = F.transform(F.zip_with("x", F.lit(total), lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s.cast("long"))), lambda a: F.try_multiply(a, a))
    deviation = F.aggregate(times, F.lit(0).cast("long"), F.try_add)
    explained = [float(max(e, 0.0) / trace) if trace > 0 else None for e in values[:k]]
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("component"), F.get("y", F.lit(i)).alias("whitened"), F.lit(explained[i]).cast("double").alias("explained")) for i in range(k)))).alias("c")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), each).select(
        "vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error")
    )
