"""Which keys payloads have, how often they are filled and whether they could tell rows apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import ratio
from tallyhouse.sources.folders import stored

#: Levels that a payload may have; deeper ones are an error, not left out.
MOST_LEVELS = 64


def scalars(payloads: DataFrame, column: str) -> DataFrame:
    """path, value (text) of every scalar below the objects and arrays of ``column`` (JSON text), nulls and empty texts left out: ``a.b`` for keys, ``[]`` for any place of an array.

    A level is one explode of variants; what is nested is stored and taken apart in turn, until nothing is.
    """
    level = payloads.select(F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    found = []
    for _ in range(MOST_LEVELS):
        inner = level.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        inner = inner.select(name.alias("path"), F.col("value").alias("v")).withColumn("kind", F.schema_of_variant("v"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        found.append(inner.where(~nested).select("path", F.col("v").cast("string").alias("value")).where("value <> ''"))
        level = stored(inner.where(nested).select("path", "v"), "nested")
        if not level.take(1):
            return reduce(DataFrame.union, found)
    raise ValueError(f"payloads of more than {MOST_LEVELS} levels")


def profile(payloads: DataFrame, column: str, known: list[str] = ()) -> DataFrame:
    """A row a path that occurs or is ``known``: path, total (payloads), filled (values that are not empty), n_values, fill_rate, uniqueness (values to filled), known, and sketch, from which ``merged`` estimates n_values of several tables together.

    Payloads that are null or no JSON count in the total only. Equal values are counted before they are shuffled.
    """
    total = payloads.agg(F.count("*").alias("total"))
    values = scalars(payloads, column).groupBy("path", "value").agg(F.count("*").alias("n"))
    sums = values.groupBy("path").agg(F.sum("n").alias("filled"), F.count("*").alias("n_values"), F.hll_sketch_agg("value").alias("sketch"))
    names = payloads.sparkSession.createDataFrame([(k, True) for k in known], "path string, known boolean")
    rows = sums.join(names, "path", "full").join(total, F.lit(True))  # total is one row
    zero = F.lit(0).cast("long")
    filled, n_values = F.coalesce("filled", zero), F.coalesce("n_values", zero)
    return rows.select("path", "total", filled.alias("filled"), n_values.alias("n_values"), ratio(filled, F.col("total")).alias("fill_rate"), ratio(n_values, filled).alias("uniqueness"), F.coalesce("known", F.lit(False)).alias("known"), "sketch")


def merged(profiles: DataFrame) -> DataFrame:
    """path, filled and about how many values there are, over profiles of several tables: their sketches are united, no value is read again."""
    return profiles.where("sketch is not null").groupBy("path").agg(F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about_values"))
