"""Depots, positions, prices and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.numbers import money, ratio, total
from tallyhouse.operators.versions import upsert

#: Buckets of instrument types; the rest is OTHER_BUCKET.
BUCKETS = {"SHARE": "Aktien", "STOCK": "Aktien", "ETF": "ETFs", "FUND": "ETFs", "BOND": "Anleihen", "BONDS": "Anleihen"}
OTHER_BUCKET = "Sonstiges"
RANGES = {"1D": 1, "1W": 7, "1M": 31, "1Y": 365}


def bucket(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.upper(kind), F.lit(""))), F.lit(OTHER_BUCKET))


def day_before() -> Column:
    """A position's value of the day before: the stored one, else price times quantity; null where neither is known or it is not positive."""
    priced = F.when(F.col("prev_day_price") != 0, F.col("prev_day_price") * F.col("quantity"))
    value = F.coalesce(F.col("prev_day_value").cast("decimal(28,6)"), priced.cast("decimal(28,6)"))
    return F.when(value > 0, value)


def summary(positions: DataFrame, depots: DataFrame) -> DataFrame:
    """Value, purchase and gains over all positions, how many there are and how many depots, and how fresh they are; the daily gain counts those with a value of the day before."""
    before = day_before()
    one = positions.agg(total(F.col("current_value")).alias("value"), total(F.col("purchase_value")).alias("purchase"), total(F.when(before.isNotNull(), F.coalesce("current_value", F.lit(0)) - before)).alias("daily_gain"), total(before).alias("day_before"), F.count("*").alias("n"), F.max("as_of").alias("last_as_of"))
    one = one.join(depots.agg(F.count("*").alias("depots")), F.lit(True))
    return one.select("value", "purchase", money(F.col("value") - F.col("purchase")).alias("gain"), ratio((F.col("value") - F.col("purchase")) * 100, F.col("purchase"), 2).alias("gain_pct"), "daily_gain", ratio(F.col("daily_gain") * 100, F.col("day_before"), 2).alias("daily_gain_pct"), "n", "depots", "last_as_of")


def allocation(positions: DataFrame, instruments: DataFrame) -> DataFrame:
    """Value of each bucket and its share of all; buckets that are not positive are left out, but count in the whole."""
    sums = positions.join(instruments, "isin").groupBy(bucket(F.col("instrument_type")).alias("bucket")).agg(total(F.col("current_value")).alias("value"))
    share = ratio(F.col("value") * 100, F.sum("value").over(W.Window.partitionBy()), 2)
    return sums.withColumn("share_pct", share).where("value > 0")


def depot_totals(depots: DataFrame, positions: DataFrame) -> DataFrame:
    """Sums of each depot and how fresh they are, empty ones included."""
    sums = positions.groupBy("depot_id").agg(F.sum("current_value").alias("v"), F.sum("purchase_value").alias("p"), F.count("*").alias("n"), F.max("as_of").alias("as_of"))
    both = depots.join(sums, "depot_id", "left").select("depot_id", money(F.coalesce("v", F.lit(0))).alias("value"), money(F.coalesce("p", F.lit(0))).alias("purchase"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "as_of")
    return both.withColumn("gain", money(F.col("value") - F.col("purchase")))


def position_gains(positions: DataFrame, instruments: DataFrame) -> DataFrame:
    """Gains of each position and its weight in its depot."""
    sums = positions.groupBy("depot_id").agg(F.sum("current_value").alias("all_"))
    gain = F.col("current_value") - F.col("purchase_value")
    return positions.join(sums, "depot_id").join(instruments, "isin").select("depot_id", "isin", "name", money(F.col("current_value")).alias("value"), money(gain).alias("gain"), ratio(gain * 100, F.col("purchase_value"), 2).alias("gain_pct"), money(F.col("current_value") - day_before()).alias("daily_gain"), ratio(F.col("current_value") * 100, F.col("all_"), 2).alias("weight_pct"))


def snapshots(depots: DataFrame, positions: DataFrame) -> DataFrame:
    """A row a depot, and one of all with a null depot."""
    joined = depots.select("depot_id").join(positions, "depot_id", "left")
    return joined.rollup("depot_id").agg(total(F.col("current_value")).alias("total_value"), total(F.col("purchase_value")).alias("total_purchase_value"))


def taken(depots: DataFrame, positions: DataFrame, day: str) -> DataFrame:
    """Snapshots of a day: depot_id, null for all together, snapshot_date and the sums."""
    return snapshots(depots, positions).select("depot_id", F.to_date(F.lit(day)).alias("snapshot_date"), "total_value", "total_purchase_value")


def keep_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with ``new`` put in by depot and day, the row of all depots like any other: what is taken again on a day replaces what was."""
    return upsert(stored, new, ["depot_id", "snapshot_date"])


def performance(snapshots_: DataFrame, span: str, ref: str) -> DataFrame:
    """Whole-portfolio snapshots of a range that ends at ``ref``."""
    rows = snapshots_.where(F.col("depot_id").isNull() & (F.col("snapshot_date") <= F.to_date(F.lit(ref))))
    return rows if span == "MAX" else rows.where(F.col("snapshot_date") >= F.date_sub(F.to_date(F.lit(ref)), RANGES[span]))


def dividend_yield(transactions: DataFrame, positions: DataFrame, ref: str, days: int = 365) -> DataFrame:
    """Dividends of the last ``days`` in per cent of today's value."""
    day = F.to_date(F.lit(ref))
    paid = transactions.where((F.col("transaction_type") == "DIVIDEND") & F.col("booking_date").between(F.date_sub(day, days), day)).agg(total(F.col("amount")).alias("dividends"))
    return paid.join(positions.agg(total(F.col("current_value")).alias("value")), F.lit(True)).select("dividends", "value", ratio(F.col("dividends") * 100, F.col("value"), 2).alias("yield_pct"))


def monthly_savings(plans: DataFrame) -> DataFrame:
    per = F.when(~F.col("active"), 0).when(F.col("interval") == "quarterly", F.col("amount") / 3).when(F.col("interval") == "yearly", F.col("amount") / 12).otherwise(F.col("amount"))
    return plans.agg(F.round(F.coalesce(F.sum(per.cast("double")), F.lit(0.0)), 2).alias("monthly_savings"), F.count_if("active").alias("active_plans"))


def instruments(from_positions: DataFrame, from_transactions: DataFrame) -> DataFrame:
    """One row an isin: the latest position's data, else those of its transactions."""
    both = from_positions.withColumn("rank", F.lit(0)).unionByName(from_transactions.withColumn("rank", F.lit(1)))
    best = both.groupBy("isin").agg(F.min_by(F.struct("name", "instrument_type"), F.struct("rank", (-F.col("seq")).alias("s"))).alias("b"))
    return best.select("isin", "b.name", "b.instrument_type")


def price_backfill(stored: DataFrame, fetched: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts): fetched prices of days in range that are not stored, one a day; counts of fetched, inserted and skipped."""
    wanted = fetched.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    once = wanted.groupBy("isin", "date").agg(F.min("close").alias("close"))
    new = once.join(stored.select("isin", "date"), ["isin", "date"], "left_anti")
    counts = wanted.agg(F.count("*").alias("fetched")).join(new.agg(F.count("*").alias("inserted")), F.lit(True))
    return new, counts.withColumn("skipped", F.col("fetched") - F.col("inserted"))


def plan_report(positions: DataFrame, instruments_: DataFrame, targets: DataFrame, plans: DataFrame, cap_pct: float = 5.0) -> DataFrame:
    """Weight of each instrument, its target (its own before its bucket's), the gap, whether it is over the cap, and its savings plan.

    The cap binds instruments that are neither funds nor named so, unless their own maximum allows more.
    """
    held = positions.groupBy("isin").agg(F.sum("current_value").alias("v")).join(instruments_, "isin").withColumn("bucket", bucket(F.col("instrument_type")))
    whole = positions.join(instruments_.select("isin"), "isin", "left_semi").agg(F.sum("current_value").alias("whole"))
    own = targets.where("target_type = 'isin'").select(F.col("target_key").alias("isin"), F.struct("target_pct", "max_pct").alias("own"))
    group = targets.where("target_type = 'bucket'").select(F.col("target_key").alias("bucket"), F.struct("target_pct", "max_pct").alias("group"))
    rows = held.join(F.broadcast(whole), F.lit(True)).withColumn("weight_pct", ratio(F.col("v") * 100, F.col("whole"), 4)).join(own, "isin", "left").join(group, "bucket", "left").withColumn("t", F.coalesce("own", "group"))
    fund = F.upper("instrument_type").isin("ETF", "FUND") | F.contains(F.lower("name"), F.lit("etf"))
    over = ~F.coalesce(fund, F.lit(False)) & (F.col("weight_pct") > cap_pct) & (F.col("t.max_pct").isNull() | (F.col("weight_pct") > F.col("t.max_pct")))
    rows = rows.join(plans.where("active").select("isin", F.lit(True).alias("has_plan")), "isin", "left")
    return rows.select("isin", "name", "bucket", money(F.col("v")).alias("value"), "weight_pct", F.col("t.target_pct").cast("double").alias("target_pct"), F.round(F.col("t.target_pct").cast("double") - F.col("weight_pct"), 4).alias("gap_pct"), over.alias("over_cap"), F.coalesce("has_plan", F.lit(False)).alias("has_plan"))


def plan_suggestions(report: DataFrame, least_gap: float = 0.5) -> DataFrame:
    """Stop saving into what is over the cap; put what is short of its target first."""
    pause = F.when(F.col("over_cap") & F.col("has_plan"), F.struct(F.lit("pause_savings_plan").alias("kind"), F.lit("warning").alias("severity")))
    first = F.when(F.col("gap_pct") > least_gap, F.struct(F.lit("prioritize_underweight").alias("kind"), F.lit("info").alias("severity")))
    return report.select("isin", F.explode(F.array_compact(F.array(pause, first))).alias("s")).select("isin", "s.kind", "s.severity")
