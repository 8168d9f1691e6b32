"""Whitening of embeddings: distributed moments, an eigensolver for the leading components, a broadcast projection.

Entries are coded as whole numbers ``floor(1024 * c) + 100000``. Sums of these are exact; second moments are centred before they are
multiplied. The driver sees one covariance matrix (dimensions squared), never a row: Householder reflections make it tridiagonal, Sturm
counts bisect its leading eigenvalues, inverse iteration gives their vectors, orthogonalised within clusters, and the reflections
carry them back.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, getcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path, scratch_path
from .text import fresh

#: Coding of entries; components returned; eigenvalues closer than this share of the norm are a cluster; smallest share of the trace that counts as variance.
SCALE, SHIFT, COMPONENTS, CLUSTER, FLAT = 1024, 100_000, 8, 1e-3, 1e-12
#: A coded entry must stay below this, so that floats hold it exactly.
LARGEST = float(1 << 52)
#: Rows whose differences are held at once.
ROWS = 4096


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, beside, q)`` with ``q.T @ a @ q`` tridiagonal, by Householder reflections."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.linalg.norm(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w -= v * (v @ w)
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, a[k + 1, k])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def larger(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are above each ``x``."""
    tiny = np.finfo(float).tiny * 4 + np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(beside).max(initial=0)) * 1e-16
    pivot = diagonal[0] - x
    count = (pivot > 0).astype(int)
    for d, b in zip(diagonal[1:], beside):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - x - b * b / pivot
        count += pivot > 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring floats."""
    reach = np.abs(np.r_[beside, 0]) + np.abs(np.r_[0, beside])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    rank = np.arange(1, k + 1)
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = larger(diagonal, beside, middle) >= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """``(tridiagonal - shift) x = b`` by elimination with row exchanges; zero pivots count as ``tiny``."""
    n = len(diagonal)
    rows, x = np.zeros((n, 3)), b.copy()
    now = [diagonal[0] - shift, beside[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        following = [beside[i], diagonal[i + 1] - shift, beside[i + 1] if i + 2 < n else 0.0]
        if abs(following[0]) > abs(now[0]):
            now, following = following, now
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(now[0]) < tiny:
            now[0] = tiny
        share = following[0] / now[0]
        rows[i] = now
        x[i + 1] -= share * x[i]
        now = [following[1] - share * now[1], following[2] - share * now[2], 0.0]
    rows[-1] = [now[0] if abs(now[0]) >= tiny else tiny, 0, 0]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - rows[i, 1] * (x[i + 1] if i + 1 < n else 0) - rows[i, 2] * (x[i + 2] if i + 2 < n else 0)) / rows[i, 0]
        if abs(x[i]) > 1e100:  # several pivots were zero
            x /= abs(x[i])
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    diagonal, beside, q = tridiagonal(a)
    values = leading_values(diagonal, beside, k)
    norm = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0)) or 1.0
    beside = np.where(np.abs(beside) > np.finfo(float).eps * norm, beside, 0.0)
    tiny, draw, out = np.finfo(float).eps * norm, np.random.default_rng(0), []
    for i, value in enumerate(values):
        near = [out[j] for j in range(i) if values[j] - value <= CLUSTER * norm]
        x = draw.standard_normal(len(diagonal))
        for _ in range(6):
            for _ in range(2):
                for other in near:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
            x = _solve(diagonal, beside, value, x, tiny)
            x /= np.abs(x).max()
        for _ in range(2):
            for other in near:
                x -= (other @ x) * other
            x /= np.linalg.norm(x)
        out.append(x)
    vectors = q @ np.array(out).T
    return values, vectors / np.linalg.norm(vectors, axis=0)


def _blocks(batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and coded entries of at most ROWS rows at a time."""
    column = batch.column(place)
    for begin in range(0, batch.num_rows, ROWS):
        part = column.slice(begin, ROWS)
        c = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
        yield begin, np.floor(SCALE * c).astype(np.int64) + SHIFT


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be coded, all of one length (the most frequent one, of equals the longest)."""
    entry = F.col(vector)
    whole = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(LARGEST / SCALE / 2), F.lit(False)))
    rows = vectors.filter(whole)
    sizes = rows.groupBy(F.size(entry).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(entry) == (sizes["d"] if sizes else 0))


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for _, x in _blocks(batch, 0):
                n += len(x)
                # halves, so that no sum of a block leaves 64 bits
                own = [(int(h) << 20) + int(l) for h, l in zip((x >> 20).sum(axis=0), (x & ((1 << 20) - 1)).sum(axis=0))]
                sums = own if sums is None else [a + b for a, b in zip(sums, own)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = vectors.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # a row a dimension
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _second_moments(rows: DataFrame, blocks, n: int, dimensions: int) -> np.ndarray:
    """Sum of products over all rows, divided by ``n``; ``blocks`` gives a batch's centred rows. A matrix row is a row of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            for x in blocks(batch):
                total += x.T @ x
        i, j = np.divmod(np.arange(dimensions**2), dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    found = rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # dimensions squared
    out = np.zeros((dimensions, dimensions))
    out[found["i"], found["j"]] = found["v"]
    return (out + out.T) / 2 / n


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, column: str = "whitened") -> DataFrame:
    """All columns of ``vectors`` but the vector, with ``n``, ``deviation``, ``column`` (an array, one number a component), ``explained`` (the
    same for every row) and ``identity_error``.

    The components are the leading unit eigenvectors of the covariance (divisor n) of the coded vectors of all rows that stay. Rows go if
    their vector is null or empty, holds null, NaN, infinite entries or such of 2^41 or more in size (their codes would not be exact), or has
    another length than most. deviation: squared distance of n times the coded vector from the sum, exact (decimal; null from 39 digits on). Directions
    without variance (repeated rows, fewer rows than components, constant dimensions) are no components, so there may be fewer
    or none; no rows give no rows. Columns of the results' names are replaced. Texts and other columns pass through.
    """
    getcontext().prec = 80
    spark = vectors.sparkSession
    names = [column, "n", "deviation", "explained", "identity_error"]
    (kept,) = fresh(vectors, "vector_kept")
    rows = usable(vectors, vector)
    only = rows.select(F.col(vector).cast("array<double>").alias(vector))
    n, sums = _sums(only)
    dimensions = len(sums)
    whole = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
    rest = np.array([s % n / n for s in sums]) if n else np.zeros(0)

    def centred(batch: pa.RecordBatch, place: int = 0) -> Iterator[np.ndarray]:
        for _, x in _blocks(batch, place):
            yield (x - whole) - rest

    covariance = _second_moments(only, centred, n, dimensions) if n else np.zeros((0, 0))
    trace = float(np.trace(covariance))
    values, directions = leading(covariance, min(components, dimensions)) if trace > 0 else (np.zeros(0), np.zeros((dimensions, 0)))
    real = values > FLAT * trace
    values, directions = values[real], directions[:, real]
    taken = {x.lower() for x in (*names, vector)}
    stay = [c for c in rows.columns if c.lower() not in taken]
    chosen = rows.select(*stay, F.col(vector).cast("array<double>").alias(kept))
    schema = T.StructType([*[chosen.schema[c] for c in stay], T.StructField(column, T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    place = len(stay)

    def deviations(x: np.ndarray) -> list[Decimal | None]:
        away = x - whole
        most = n * (int(np.abs(away).max(initial=0)) + 1)
        if dimensions * most * most < 1 << 63:
            d = n * away - np.array([s % n for s in sums], np.int64)
            return [Decimal(int(v)) for v in (d * d).sum(axis=1)]
        left = [s % n for s in sums]
        exact = [sum((n * a - r) ** 2 for a, r in zip(row, left)) for row in away.tolist()]
        return [Decimal(v) if v < 10**38 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, x in _blocks(batch, place):
                made = ((x - whole) - rest) @ directions
                arrays = pa.ListArray.from_arrays(np.arange(0, made.size + 1, max(1, made.shape[1]))[: len(x) + 1] if made.shape[1] else np.zeros(len(x) + 1, np.int32), made.ravel())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(begin, len(x)) for i in range(place)], arrays, pa.array(deviations(x), pa.decimal128(38, 0))], names=schema.fieldNames())

    path = scratch_path(spark, "whitened")
    chosen.mapInArrow(run, schema).write.parquet(path)
    stage = spark.read.schema(schema).parquet(path)
    k = len(values)

    def made(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - centre

    error = 0.0
    if k:
        centre = np.array(stage.agg(*[F.avg(F.element_at(column, i + 1)) for i in range(k)]).first(), float)
        spread = _second_moments(stage.select(column), made, n, k)
        values = np.diag(spread)  # the variances as measured: small ones keep all their digits beside large ones
        error = float(np.abs(spread / np.sqrt(np.outer(values, values)) - np.eye(k)).max())
    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if k else F.array().cast("array<double>")
    scales = F.array(*[F.lit(float(np.sqrt(v))) for v in values])
    white = F.zip_with(column, scales, lambda y, s: y / s) if k else F.col(column)
    out = stage.withColumns({column: white, "n": F.lit(n).cast("long"), "explained": shares, "identity_error": F.lit(error)})
    return out
