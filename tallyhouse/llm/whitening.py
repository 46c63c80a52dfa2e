"""Whitening of integer-scaled embeddings through a compensated covariance.

Sums are exact. The covariance is of centred rows, in double-double: each centred entry is cut into slices of so few bits
that sums of products of slices over a batch are exact doubles, whatever their order, so a batch's outer products are
matrix products without any error; what they add up to is carried as a high and a low part by error-free addition, first
over a task's batches and then over tasks. The matrix, dimension by dimension, is all that comes to the driver; it is
solved there by reduction to tridiagonal form and divide and conquer (LAPACK's ``syevd``, which is ``numpy.linalg.eigh``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import written
from tallyhouse.llm.vectors import matrix

#: An entry c becomes floor(SCALE * c) + OFFSET; entries beyond LARGEST have no exact long and their rows take no part.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**40
#: Partial sums that tasks hand on at most, each the size of the covariance; rows whose products are summed at once; bits of a slice and how many slices a centred entry has: 2 * 20 + 13 = 53 and 4 * 20 bits of each batch's largest entry.
PARTS, BATCH, BITS, SLICES = 4096, 1 << 13, 20, 4


class Fit(NamedTuple):
    """What was learned: rows, exact sums of each dimension, eigenvalues and unit eigenvectors (as columns) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def takes_part(column: str) -> Column:
    """Whether a vector is neither null nor empty and has finite numbers only, of which none is too large."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST))
    return F.coalesce((F.size(column) > 0) & fine, F.lit(False))


def scaled(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) of the rows that take part; those of the most frequent length, the smaller of two."""
    rows = df.where(takes_part(vector_column)).select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    entry = lambda c: F.floor(c.cast("double") * SCALE) + OFFSET
    return rows.where(F.size("v") == (most["d"] if most else 0)).select("vec_id", F.transform("v", entry).alias("x"))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b without error: the rounded sum and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(y: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Arrays of at most BITS bits that add up to y + low as far as SLICES of them reach; each an exact multiple of one power of two."""
    out = []
    top = np.abs(y).max(initial=0.0)
    if not top:
        return out
    unit = 2.0 ** (np.ceil(np.log2(top)) + 1 - BITS)
    for _ in range(SLICES):
        part = np.rint(y / unit) * unit
        y, low = two_sum(y - part, low)
        out.append(part)
        unit *= 2.0**-BITS
    return out


def outer(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products of rows less a double-double mean, as a double-double matrix."""
    d = x.shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(x), BATCH):
        y, e = two_sum(x[at : at + BATCH], -high)
        parts = slices(*two_sum(y, e - low))
        for p in range(len(parts)):
            for q in range(len(parts) - p):  # what is left out lies below the last slice of a product
                product = parts[p].T @ parts[q]  # exact
                total = added(total, (product, np.zeros_like(product)))
    return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """A task's vectors, some thousand at a time, whatever the size of Arrow's batches."""
    held: list[np.ndarray] = []
    for batch in batches:
        if len(batch):
            held.append(matrix(batch.column(0)))
        if sum(map(len, held)) >= BATCH // 2:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for x in _rows(batches):  # below 2^41 each, so thousands of them fit a long
        own = x.astype(np.int64).sum(axis=0).astype(object)
        n, sums = n + len(x), own if sums is None else sums + own
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``x`` (arrays of long, equally long) and the exact sum of each dimension."""
    parts = rows.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(_partial_sums, "n long, sums array<string>")
    found = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def _partial_products(batches: Iterator[pa.RecordBatch], high: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _rows(batches):
        own = outer(x, high, low)
        total = own if total is None else added(total, own)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(high)), pa.int32()), "high": pa.array(list(total[0])), "low": pa.array(list(total[1]))})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """High and low parts of a row of the matrix, from all tasks in a fixed order; rows come one after the other."""
    own, total = None, None
    for batch in batches:
        for i, h, w in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), matrix(batch.column(2)), strict=True):
            if i != own:
                if own is not None:
                    yield _row(own, total)
                own, total = i, (np.zeros_like(h), np.zeros_like(h))
            total = added(total, (h, w))
    if own is not None:
        yield _row(own, total)


def _row(i: int, total: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "high": pa.array([total[0]]), "low": pa.array([total[1]])})


def covariance(rows: DataFrame, n: int, mean: list[Fraction]) -> np.ndarray:
    """Covariance, divisor n, of ``x`` (arrays of numbers), centred on ``mean`` before multiplying; at most PARTS partial matrices are shuffled, by row of the matrix."""
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high, strict=True)])
    doubles = rows.select(F.col("x").cast("array<double>").alias("x"))
    parts = doubles.coalesce(PARTS).mapInArrow(partial(_partial_products, high=high, low=low), "i int, high array<double>, low array<double>")
    merged = parts.repartition("i").sortWithinPartitions("i", "high", "low").mapInArrow(_merged, "i int, high array<double>, low array<double>")
    found = merged.orderBy("i").collect()  # a row a dimension
    total = np.array([[float((Fraction(h) + Fraction(w)) / n) for h, w in zip(r["high"], r["low"], strict=True)] for r in found])
    return (total + total.T) / 2


def solve(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those whose eigenvalue is nothing but rounding are left out."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values > len(v) * np.finfo(float).eps * max(values[0], 0.0)
    return values[kept], vectors[:, kept]


def fit(rows: DataFrame) -> Fit | None:
    """The whitening of ``rows`` (see ``scaled``); None where there is none."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    v = covariance(rows, n, [Fraction(s, n) for s in sums])
    values, vectors = solve(v)
    return Fit(n, sums, values, vectors, float(np.trace(v)))


def _whitened(batches: Iterator[pa.RecordBatch], model: Fit, components: int) -> Iterator[pa.RecordBatch]:
    mean = [Fraction(s, model.n) for s in model.sums]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high, strict=True)])
    axes = model.vectors[:, :components] / np.sqrt(model.values[:components])
    sums = np.array(model.sums, object)
    for batch in batches:
        if not len(batch):
            continue
        x = matrix(batch.column(1))
        y, e = two_sum(x, -high)
        away = x.astype(np.int64).astype(object) * model.n - sums
        far = max(abs(away.min()), abs(away.max()))
        if far * far * len(sums) < 1 << 63:
            away = away.astype(np.int64)
        deviation = [str(int(d)) for d in (away * away).sum(axis=1)]
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "deviation": pa.array(deviation), "x": pa.array(list((y + (e - low)) @ axes), pa.list_(pa.float64()))})


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8) -> DataFrame:
    """Whitened rows of ``df``, a row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation (decimal(38,0)), whitened, explained, identity_error.

    Rows whose vector is null, is empty, has a null or non-finite entry or one beyond LARGEST, or is not of the most
    frequent length, take no part; all others do, a zero vector, one without an id and repeated rows included. Fewer
    components come where the covariance has fewer eigenvalues above rounding; none, and so no row, where all vectors are
    equal or there is none. Extra columns are ignored. The whitened table is written once, as it is read three times; what
    a task holds is a batch and a matrix of the square of the dimension.
    """
    spark = df.sparkSession
    rows = scaled(df, id_column, vector_column)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows)
    k = min(components, len(model.values)) if model else 0
    if not k:
        return spark.createDataFrame([], schema)
    plain = rows.select("vec_id", F.col("x").cast("array<double>").alias("x"))
    white = written(plain.mapInArrow(partial(_whitened, model=model, components=k), f"vec_id {kind}, deviation string, x array<double>"), "whitened")
    mean = [s / model.n for s in _compensated_sums(white)]
    error = float(np.abs(covariance(white, model.n, mean) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:k]))
    each = white.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("x").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _rows(batches):
        for row in x:
            total = added(total or (np.zeros_like(row), np.zeros_like(row)), (row, np.zeros_like(row)))
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total[0])), pa.int32()), "high": pa.array([[h] for h in total[0]]), "low": pa.array([[w] for w in total[1]])})


def _compensated_sums(rows: DataFrame) -> list[Fraction]:
    """The sum of each dimension of ``x`` (arrays of double), as an exact fraction of a double-double."""
    form = "i int, high array<double>, low array<double>"
    parts = rows.select("x").coalesce(PARTS).mapInArrow(_task_sums, form)
    found = parts.repartition("i").sortWithinPartitions("i", "high", "low").mapInArrow(_merged, form).orderBy("i").collect()
    return [Fraction(r["high"][0]) + Fraction(r["low"][0]) for r in found]
