"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import discard, written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (id, component), the smallest id reachable, for every id in a link.

    Alternates large-star and small-star steps: each node hands its larger, then its smaller neighbours
    to the smallest one, until nothing changes; a logarithmic number of rounds, whose work follows the
    number of links whatever the size of a component. Each round is written to the shared folder, and what it was made from deleted.
    """
    edges = written(_directed(links), "links")
    mark = None
    while True:
        both = edges.union(edges.select("low", "high")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = written(large.where("high > low").distinct(), "links")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(least, "high").select(F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct("high", F.col("m").alias("low")))).alias("e")).select("e.*")
        past, edges = edges, written(moved.where("high > low").distinct(), "links")
        discard(large)
        discard(past)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    tops = edges.select(F.col("low").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("high").alias("id"), F.col("low").alias("component")).union(tops)


def _directed(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
