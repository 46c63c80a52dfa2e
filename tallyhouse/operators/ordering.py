"""Places in an order, without a task that holds all rows or a key's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.sources.folders import stored


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` stored in ranges of (keys, order), each with its ``_part`` and its ``_line`` there, and of each part and key the first line, how many rows it has and how many stand in parts before: no task or window holds a key's rows, however many there are."""
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_line": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "dealt")
    counts = placed.groupBy(*keys, "_part").agg(F.min("_line").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.Window.partitionBy(*keys).orderBy("_part")) - F.col("_rows")
    return placed, counts.withColumn("_before", before)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their number, from 1, among those of equal ``keys`` (not null) in ``order``."""
    placed, counts = dealt(rows, keys, order)
    counts = stored(counts, "counts")  # a row a key and part: of known size, they go to the rows where they are few
    found = placed.join(counts, [*keys, "_part"])
    return found.withColumn(name, F.col("_before") + F.col("_line") - F.col("_first") + 1).select(*rows.columns, name)
