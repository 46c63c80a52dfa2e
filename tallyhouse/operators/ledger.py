"""Filters, joins and sums over a ledger.

A ledger has id, booking_date, amount, source, sender, recipient, description, category_id and the flags is_refund, internal_transfer, is_recurring, is_outlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.numbers import label, money, ratio, total

UNCATEGORISED = "Unkategorisiert"


def income() -> Column:
    """Credits that are no refund."""
    return F.when((F.col("amount") > 0) & ~F.col("is_refund"), F.col("amount"))


def expense() -> Column:
    """Debits, and refunds whatever their sign."""
    return F.when((F.col("amount") < 0) | F.col("is_refund"), F.col("amount"))


def between(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """Rows booked from ``start`` to ``end``, both included."""
    return ledger.where(F.col("booking_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def selected(ledger: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None, source: str | None = None, tags: tuple[DataFrame, list[str]] | None = None, text: str | None = None, **flags: bool) -> DataFrame:
    """Rows that meet all conditions given; ``flags`` are by column. ``tags`` is (tags of transactions, names): one of them is enough and no row comes twice."""
    if start:
        ledger = ledger.where(F.col("booking_date") >= F.to_date(F.lit(start)))
    if end:
        ledger = ledger.where(F.col("booking_date") <= F.to_date(F.lit(end)))
    for name, value in (("category_id", category), ("source", source), *flags.items()):
        if value is not None:
            ledger = ledger.where(F.col(name) == value)
    if text:
        low = F.lit(text.lower())
        ledger = ledger.where(F.contains(F.lower(F.coalesce("recipient", F.lit(""))), low) | F.contains(F.lower(F.coalesce("sender", F.lit(""))), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low))
    if tags:
        ledger = ledger.join(tags[0].where(F.col("tag").isin(tags[1])).select("id"), "id", "left_semi")
    return ledger


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def cashflow(ledger: DataFrame) -> DataFrame:
    """Income, expenses, net and count of each month that has a row; internal transfers do not count."""
    by = ledger.where(~F.col("internal_transfer")).groupBy(F.year("booking_date").cast("bigint").alias("year"), F.month("booking_date").cast("bigint").alias("month"))
    return by.agg(total(income()).alias("income"), total(expense()).alias("expenses"), F.count("*").alias("n")).withColumn("net", money(F.col("income") + F.col("expenses")))


def summary(ledger: DataFrame) -> DataFrame:
    """One row: income, expenses, net, savings rate as a fraction and in per cent, count."""
    one = ledger.where(~F.col("internal_transfer")).agg(total(income()).alias("income"), total(expense()).alias("expenses"), F.count("*").alias("n")).withColumn("net", money(F.col("income") + F.col("expenses")))
    return one.withColumns({"savings_rate": ratio(F.col("net"), F.col("income")), "savings_rate_pct": F.when(F.col("income") > 0, ratio(F.col("net") * 100, F.col("income"), 1)).otherwise(0.0)})


def by_category(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Totals of rows with a category."""
    return ledger.where(~F.col("internal_transfer")).join(categories, "category_id").groupBy("category_id", "name").agg(total(F.col("amount")).alias("total"), F.count("*").alias("n"))


def breakdown(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Totals of every category, missing ones named, with their share of all that was spent in per cent."""
    sums = ledger.where(~F.col("internal_transfer")).join(categories, "category_id", "left").groupBy(F.coalesce("name", F.lit(UNCATEGORISED)).alias("name")).agg(total(F.col("amount")).alias("total"))
    spent = F.sum(F.when(F.col("total") < 0, -F.col("total"))).over(W.Window.partitionBy())
    return sums.withColumn("share_pct", F.when(F.col("total") < 0, ratio(-F.col("total") * 100, spent, 1)).otherwise(0.0))


def last_months(ledger: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` months with rows."""
    months = ledger.where(~F.col("internal_transfer")).groupBy(label(F.col("booking_date")).alias("month")).agg(total(income()).alias("income"), total(expense()).alias("expenses"))
    return months.orderBy(F.desc("month")).limit(n).orderBy("month")


def budget_spending(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """What each active budget (category_id, name, monthly_limit, warning, critical, priority, is_active) has used; budgets without rows stay."""
    spent = ledger.where(~F.col("internal_transfer")).groupBy("category_id").agg(
        F.sum(F.when((F.col("amount") < 0) & ~F.col("is_refund"), F.col("amount"))).alias("gross"), F.sum(F.when(F.col("is_refund"), F.col("amount"))).alias("back"), F.count("id").alias("n"))
    both = budgets.where("is_active").join(spent, "category_id", "left").withColumns({"spent_gross": money(F.coalesce("gross", F.lit(0))), "refunded": money(F.coalesce("back", F.lit(0))), "n": F.coalesce("n", F.lit(0).cast("bigint"))})
    both = both.withColumn("net", money(F.col("spent_gross") + F.col("refunded")))
    use = F.coalesce(F.try_divide(F.abs("net").cast("double"), F.col("monthly_limit").cast("double")), F.lit(0.0))
    return both.select(
        "category_id", "name", "priority", money(F.col("monthly_limit")).alias("monthly_limit"), "spent_gross", "refunded", "net", money(F.col("monthly_limit") + F.col("net")).alias("remaining"), F.round(use, 4).alias("utilisation"),
        F.when(use >= F.col("critical").cast("double"), "critical").when(use >= F.col("warning").cast("double"), "warning").otherwise("ok").alias("status"), "n")


def budget_risks(spending: DataFrame) -> DataFrame:
    return spending.where(F.col("status").isin("warning", "critical") | (F.col("remaining") < 0))


def new_counterparties(ledger: DataFrame, since: str) -> DataFrame:
    """Recipients that were first paid on or after a day."""
    return ledger.where("recipient is not null").groupBy("recipient").agg(F.min("booking_date").alias("first_seen")).where(F.col("first_seen") >= F.to_date(F.lit(since)))


def uncategorised(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("category_id").isNull() & ~F.col("internal_transfer"))


def account_totals(ledger: DataFrame) -> DataFrame:
    """In, out, net and count of each source, and of all (source null)."""
    sums = ledger.rollup("source").agg(total(F.when(F.col("amount") > 0, F.col("amount"))).alias("total_in"), total(F.when(F.col("amount") < 0, F.col("amount"))).alias("total_out"), F.count("*").alias("n"))
    return sums.withColumn("net", money(F.col("total_in") + F.col("total_out")))


def top_counterparts(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Those that most was paid to."""
    name = F.coalesce(F.when(F.trim("recipient") != "", F.col("recipient")), F.lit("Unbekannt"))
    return ledger.where("amount < 0").groupBy(name.alias("counterpart")).agg(total(F.col("amount")).alias("total"), F.count("*").alias("n")).orderBy("total", "counterpart").limit(n)


def frequent_counterparts(ledger: DataFrame, least: int = 3, n: int = 10) -> DataFrame:
    return ledger.where("amount < 0 and recipient is not null").groupBy(F.col("recipient").alias("counterpart")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("total")).where(F.col("n") >= least).orderBy(F.desc("n"), "counterpart").limit(n)


def export(ledger: DataFrame, tags: DataFrame, most: int = 50_000) -> DataFrame:
    """Newest first, as text where it is written so: dates, counterparty, amount and all tags of a row in one."""
    joined = tags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    newest = ledger.orderBy(F.desc("booking_date"), "id").limit(most)
    return newest.join(joined, "id", "left").select("id", "booking_date", "valuation_date", "description", F.coalesce(F.nullif("recipient", F.lit("")), F.nullif("sender", F.lit("")), F.lit("")).alias("counterparty"), F.col("amount").cast("string").alias("amount"), F.coalesce("category_id", F.lit("")).alias("category"), F.coalesce("tags", F.lit("")).alias("tags"))
