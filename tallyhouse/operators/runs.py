"""Runs of jobs and agents: health, suggestions, cost, stalls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.numbers import ratio

SUGGESTIONS = "array<struct<transaction_id:string,suggested_category_id:string,confidence:string,reasoning:string>>"


def suggestions(runs: DataFrame) -> DataFrame:
    """A row a suggestion of ``runs`` (run_id, result as JSON of either shape): run_id, pos, transaction_id, suggested_category_id, confidence (null unless from 0 to 1)."""
    text = F.coalesce(F.get_json_object("result", "$.categorization.suggestions"), F.get_json_object("result", "$.suggestions"))
    each = runs.select("run_id", F.posexplode(F.from_json(text, SUGGESTIONS)).alias("pos", "s"))
    value = F.col("s.confidence").try_cast("double")
    return each.select("run_id", "pos", "s.transaction_id", "s.suggested_category_id", F.when(value.between(0, 1), value).alias("confidence"))


def health(runs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: runs, suggestions, how many pass the threshold and their share, mean confidence."""
    s = suggestions(runs).agg(F.count("*").alias("suggestions"), F.count_if(F.col("confidence") >= threshold).alias("high"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return runs.agg(F.count("*").alias("runs")).join(s, F.lit(True)).withColumn("auto_apply_rate", ratio(F.col("high"), F.col("suggestions")))


def best_suggestion(found: DataFrame) -> DataFrame:
    """The most confident suggestion of each transaction, the first of equals."""
    order = W.Window.partitionBy("transaction_id").orderBy(F.col("confidence").desc_nulls_last(), "run_id", "pos")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def pending(found: DataFrame, ledger: DataFrame, rejected: DataFrame, categories: DataFrame) -> DataFrame:
    """Best suggestions for rows that still have no category and that nobody has turned down, with the category's name."""
    open_ = best_suggestion(found.join(rejected, ["transaction_id", "suggested_category_id"], "left_anti"))
    rows = ledger.where("category_id is null").select(F.col("id").alias("transaction_id"), "booking_date", "amount")
    return open_.join(rows, "transaction_id").join(categories.select(F.col("category_id").alias("suggested_category_id"), "name"), "suggested_category_id", "left")


def apply_suggestions(ledger: DataFrame, best: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Fills missing categories from confident suggestions."""
    sure = best.where(F.col("confidence") >= threshold).select(F.col("transaction_id").alias("id"), F.col("suggested_category_id").alias("s"))
    return ledger.join(sure, "id", "left").withColumn("category_id", F.coalesce("category_id", "s")).drop("s")


def last_by(runs: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key."""
    return runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), F.struct(time, "run_id")).alias("b")).select(key, "b.*")


def stale(runs: DataFrame, now: str, seconds: int = 300, grace: int = 600) -> DataFrame:
    """Running rows without a sign of life for ``seconds``, or without any since they began ``grace`` seconds ago."""
    then = F.unix_timestamp(F.lit(now).cast("timestamp"))
    quiet = then - F.unix_timestamp("heartbeat_at") > seconds
    return runs.where((F.col("status") == "running") & F.when(F.col("heartbeat_at").isNotNull(), quiet).otherwise(then - F.unix_timestamp("started_at") > grace))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each model; unknown ones cost nothing. Prices are per million."""
    both = usage.groupBy("model").agg(F.sum("input_tokens").cast("bigint").alias("input_tokens"), F.sum("output_tokens").cast("bigint").alias("output_tokens")).join(prices, "model", "left")
    return both.select("model", "input_tokens", "output_tokens", F.round(F.coalesce((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6, F.lit(0.0)), 6).alias("cost"))


def field_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each field is filled, how many values it has, and whether they tell rows apart."""
    pairs = rows.select(F.explode(F.map_entries(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]))).alias("e")).select(F.col("e.key").alias("field"), F.nullif("e.value", F.lit("")).alias("v"))
    out = pairs.groupBy("field").agg(F.count("*").alias("n"), F.count("v").alias("filled"), F.countDistinct("v").alias("n_values"))
    return out.select("field", "n", "filled", "n_values", ratio(F.col("filled"), F.col("n")).alias("fill_rate"), (F.col("n_values") == F.col("filled")).alias("is_unique"))
