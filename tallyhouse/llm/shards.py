"""Ranges of a long column that spread ordered work over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds that the driver holds at most. A table that needs more shards gets its ranges cut again, by Spark, so that a shard never grows with the table.
MOST_BOUNDS = 4000


def with_shards(df: DataFrame, column: str, rows_per_shard: int, values: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``df`` with a long ``shard`` that ascends with ``column``, and how many there are: about ``rows_per_shard`` rows each; nulls come first, in shard 0.

    Rows that share a value share a shard, however many they are. ``values`` has the same values of ``column`` and is counted instead, where ``df`` is dear to compute.
    """
    values = df if values is None else values
    wanted = max(1, -(-values.count() // rows_per_shard))
    ranges = min(wanted, MOST_BOUNDS)
    bounds = _bounds(values, column, ranges)
    placed = df.withColumn("shard", range_of(column, bounds).cast("long"))
    if wanted <= MOST_BOUNDS:
        return placed, len(bounds) + 1
    finer = -(-wanted // ranges)
    cuts = values.withColumn("shard", range_of(column, bounds).cast("long")).groupBy("shard").agg(F.percentile_approx(column, [k / finer for k in range(1, finer)], 100 * finer).alias("cuts"))  # a row a range
    cut = placed.join(cuts, "shard").withColumn("shard", F.col("shard") * finer + F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(column))), F.lit(0)))
    return cut.select(*df.columns, "shard"), (len(bounds) + 1) * finer


def _bounds(df: DataFrame, column: str, ranges: int) -> list[int]:
    """Ascending values at which a new range begins."""
    if ranges == 1:
        return []
    cuts = df.select(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
    return sorted({int(c) for c in cuts or []})


def range_of(column: str, bounds: list[int]) -> Column:
    """How many bounds a value has reached, found through nested conditions: about log2 of their number of comparisons a row."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= F.lit(bounds[mid]), part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(bounds))
