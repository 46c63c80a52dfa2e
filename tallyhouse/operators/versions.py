"""Versioned rows, upserts and replacements as whole-table transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def versions(rows: DataFrame) -> DataFrame:
    """Adds version and superseded_by to ``rows`` (source, external_id, content_hash, arrival): a hash counts once, at its first arrival; rows without an external id are versions 1."""
    first = rows.withColumn("r", F.row_number().over(W.Window.partitionBy("content_hash").orderBy("arrival"))).where("r = 1").drop("r")
    # a row without an external id stands alone by its hash
    same = W.Window.partitionBy("source", "external_id", F.when(F.col("external_id").isNull(), F.col("content_hash"))).orderBy("arrival")
    return first.withColumns({"version": F.row_number().over(same).cast("bigint"), "superseded_by": F.lead("content_hash").over(same)})


def insert_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` (with version and superseded_by) and what of ``incoming`` is new; the newest stored version of an external id is superseded by the first new one.

    Only ids that come in are touched.
    """
    fresh = versions(incoming.join(stored.select("content_hash"), "content_hash", "left_anti"))
    keys = F.col("source").alias("_source"), F.col("external_id").alias("_id")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("external_id") == F.col("_id"))
    newest = stored.where("superseded_by is null").groupBy(*keys).agg(F.max("version").alias("top"))
    placed = fresh.join(newest, same, "left").withColumn("version", F.col("version") + F.coalesce("top", F.lit(0).cast("bigint"))).drop("top", "_source", "_id")
    nexts = fresh.where("version = 1 and external_id is not null").select(*keys, F.col("content_hash").alias("next"))
    kept = stored.join(nexts, same, "left").withColumn("superseded_by", F.coalesce("superseded_by", "next")).drop("next", "_source", "_id")
    return kept.unionByName(placed.select(kept.columns))


def extended(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """What ``insert_versions`` gives for ``fresh`` that are versions among themselves already, of hashes that are not stored; both sides are shuffled once.

    Both must be read from files: Spark takes a union of sides that are dealt alike for dealt alike itself.
    """
    both = stored.withColumn("_new", F.lit(False)).unionByName(fresh.select(stored.columns).withColumn("_new", F.lit(True)))
    same = W.Window.partitionBy("source", "external_id")
    top = F.max(F.when(~F.col("_new") & F.col("superseded_by").isNull(), F.col("version"))).over(same)
    next_ = F.max(F.when(F.col("_new") & (F.col("version") == 1), F.col("content_hash"))).over(same)
    named = both.where("external_id is not null").withColumns({"_top": F.coalesce(top, F.lit(0).cast("bigint")), "_next": next_})
    named = named.withColumns({"version": F.when(F.col("_new"), F.col("version") + F.col("_top")).otherwise(F.col("version")), "superseded_by": F.when(F.col("_new"), F.col("superseded_by")).otherwise(F.coalesce("superseded_by", "_next"))})
    return named.select(stored.columns).unionByName(both.where("external_id is null").select(stored.columns))


def active(rows: DataFrame) -> DataFrame:
    return rows.where("superseded_by is null")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], fixed: list[str] = (), keep_set: list[str] = ()) -> DataFrame:
    """Rows of both by ``keys``: incoming values win, but columns in ``fixed`` never change and those in ``keep_set`` only while null. Keys are null-safe."""
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])
    both = stored.withColumn("_s", F.lit(True)).alias("s").join(incoming.withColumn("_i", F.lit(True)).alias("i"), on, "full")

    def value(c: str):
        if c in keys or c in fixed:
            return F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}"))
        if c in keep_set:
            return F.coalesce(f"s.{c}", f"i.{c}")
        return F.when(F.col("_i"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))

    return both.select(*[value(c).alias(c) for c in stored.columns])


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and the rows of ``incoming`` whose key it lacks, each key once."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(stored.columns))


def replace_where(stored: DataFrame, incoming: DataFrame, column: str, values: list, keys: list[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``values`` give way to ``incoming``, each key once."""
    return stored.where(~F.col(column).isin(values)).unionByName(incoming.dropDuplicates(keys))


def replace_groups(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Groups that come in replace theirs."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").select(incoming.columns).unionByName(incoming)


def carried_over(rows: DataFrame, moves: DataFrame, columns: list[str]) -> DataFrame:
    """Values that users have set go from an old hash to the new one (``moves``: old, new) where the new row has none; rows of old hashes go."""
    old = rows.join(moves, F.col("id") == F.col("old")).select(F.col("new").alias("id"), *[F.col(c).alias(f"_{c}") for c in columns])
    kept = rows.join(moves.select(F.col("old").alias("id")), "id", "left_anti").join(old, "id", "left")
    return kept.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(rows.columns)
