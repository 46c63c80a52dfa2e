"""Common ground of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part: not null, not empty or zero, all components finite numbers."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_rows(df: DataFrame, id_column: str, vector_column: str, dimension: int | None = None) -> DataFrame:
    """id, v (array of double) of the rows that take part; with ``dimension`` those of that length."""
    rows = df.where(F.col(id_column).isNotNull() & usable(vector_column)).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows if dimension is None else rows.where(F.size("v") == dimension)


def dimension_of(df: DataFrame, id_column: str, vector_column: str) -> int | None:
    """The most frequent length of usable vectors, the smaller of two; None without any. Vectors of another length take no part."""
    found = df.where(F.col(id_column).isNotNull() & usable(vector_column)).groupBy(F.size(vector_column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else None


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, those of the lowest hashes of their id, as a matrix on the driver."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r["v"] for r in got])


def lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centres of k-means."""
    random = np.random.default_rng(seed)
    centres = x[random.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ centres.T - half).argmax(axis=1) for lo in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
