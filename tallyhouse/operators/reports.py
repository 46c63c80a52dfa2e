"""What is written for readers: exports of accounts and depots, the report of everything, bundles for an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money, ratio, total
from tallyhouse.functions.text import german_money, shortened

#: Types of accounts and their usual names.
ACCOUNT_TYPES = {"CURRENT_ACCOUNT": "girokonto", "GIRO": "girokonto", "CA": "girokonto", "SAVINGS_ACCOUNT": "tagesgeld", "TAGESGELD": "tagesgeld", "SA": "tagesgeld", "CLEARING_ACCOUNT": "verrechnungskonto", "DEPOT_VERRECHNUNGSKONTO": "verrechnungskonto", "DAS": "depot"}
#: Kinds of depot bookings; any other is OTHER.
BOOKING_TYPES = {"KAUF": "BUY", "BUY": "BUY", "VERKAUF": "SELL", "SELL": "SELL", "DIVIDENDE": "DIVIDEND", "DIVIDEND": "DIVIDEND"}
TOTAL = "GESAMT"


def _looked_up(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.upper(key)), default)


def account_name(kind: Column) -> Column:
    """The usual name of an account's type; an unknown type keeps its own, a missing one is unknown."""
    return _looked_up(ACCOUNT_TYPES, F.coalesce(kind, F.lit("")), F.coalesce(F.nullif(F.replace(F.lower(kind), F.lit(" "), F.lit("_")), F.lit("")), F.lit("unknown")))


def booking_type(kind: Column) -> Column:
    return _looked_up(BOOKING_TYPES, F.coalesce(kind, F.lit("")), F.lit("OTHER"))


def positions_with_total(positions: DataFrame, instruments: DataFrame) -> DataFrame:
    """Positions with gain and gain in per cent, and a last row of all: isin null, name GESAMT."""
    rows = positions.join(instruments.select("isin", "name"), "isin", "left").select("isin", "name", "quantity", money(F.col("current_value")).alias("value"), money(F.col("purchase_value")).alias("purchase"))
    all_ = rows.agg(total(F.col("value")).alias("value"), total(F.col("purchase")).alias("purchase"))
    both = rows.unionByName(all_.select(F.lit(None).cast("bigint").alias("isin"), F.lit(TOTAL).alias("name"), F.lit(None).cast("decimal(18,6)").alias("quantity"), "value", "purchase"))
    gain = F.col("value") - F.col("purchase")
    return both.withColumns({"gain": money(gain), "gain_pct": ratio(gain * 100, F.col("purchase"), 2)})


def trades_for_export(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """A depot's bookings as they are exported: kinds by their usual name, newest first."""
    return trades.join(instruments.select("isin", "name"), "isin", "left").select("booking_date", "isin", "name", booking_type(F.col("transaction_type")).alias("kind"), "quantity", money(F.col("amount")).alias("amount")).orderBy(F.desc("booking_date"), "isin")


def wealth(accounts: DataFrame, positions: DataFrame) -> DataFrame:
    """A row an account (kind, label, balance), one for the depot's value, and the sum of all."""
    held = positions.agg(total(F.col("current_value")).alias("balance")).select(F.lit("Depot").alias("kind"), F.lit("Wertpapierdepot").alias("label"), "balance")
    rows = accounts.select(F.lit("Konto").alias("kind"), "label", money(F.col("balance")).alias("balance")).unionByName(held)
    return rows.unionByName(rows.agg(total(F.col("balance")).alias("balance")).select(F.lit(TOTAL).alias("kind"), F.lit("").alias("label"), "balance"))


def for_agent(bookings: DataFrame, accounts: DataFrame) -> DataFrame:
    """In, out (both without a sign), net and count of each usual account name: accounts (account_id, account_type) of one type are one, and an account without bookings stays."""
    named = accounts.select("account_id", account_name(F.col("account_type")).alias("account"))
    rows = named.join(bookings, "account_id", "left")
    sums = rows.groupBy("account").agg(total(F.when(F.col("amount") > 0, F.col("amount"))).alias("total_in"), total(F.when(F.col("amount") < 0, -F.col("amount"))).alias("total_out"), F.count("amount").alias("n"))
    return sums.withColumn("net", money(F.col("total_in") - F.col("total_out")))


def counterpart(amount: Column, creditor: Column, debtor: Column) -> Column:
    """Who is on the other side: the creditor of a debit, else the debtor."""
    return F.when(amount < 0, creditor).otherwise(debtor)


def first_depot(depots: DataFrame, positions: DataFrame) -> DataFrame:
    """Totals of the first depot alone, in one row."""
    one = depots.agg(F.min("depot_id").alias("depot_id")).join(positions, "depot_id", "left")
    sums = one.agg(F.min("depot_id").alias("depot_id"), total(F.col("current_value")).alias("total_value"), total(F.col("purchase_value")).alias("total_purchase_value"), F.count("isin").alias("position_count"))
    gain = F.col("total_value") - F.col("total_purchase_value")
    return sums.withColumns({"total_gains": money(gain), "total_gains_percent": ratio(gain * 100, F.col("total_purchase_value"), 4)})


def is_agent_format(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is a report's input as ``for_agent`` shapes it (meta and depot) or a raw export (transactions); an error if it is neither."""
    found = spark.read.text(path, wholetext=True).select(F.json_object_keys("value")).first()
    names = set(found[0] or []) if found else set()
    if {"meta", "depot"} <= names:
        return True
    if {"accounts", "transactions"} & names:
        return False
    raise ValueError("neither an export nor a report's input")


def markdown(title: str, sections: list[tuple[str, DataFrame]], most: int = 50) -> str:
    """A report of tables with at most ``most`` rows each: money in German form, long texts shortened."""
    out = [f"# {title}"]
    for name, rows in sections:
        shown = [german_money(F.col(f.name)) if f.dataType.simpleString().startswith("decimal") else shortened(F.col(f.name).cast("string")) for f in rows.schema]
        lines = rows.limit(most).select([F.coalesce(c, F.lit("")).alias(f.name) for c, f in zip(shown, rows.schema, strict=True)]).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)] + ["| " + " | ".join(r) + " |" for r in lines]
    return "\n".join(out) + "\n"


def write_positions(positions: DataFrame, instruments: DataFrame, path: str) -> None:
    """Positions as a German CSV: semicolons, everything quoted, the row of all last."""
    rows = positions_with_total(positions, instruments)
    amounts = {c: F.translate(F.format_number(c, 2), ",.", ".,") for c in ("quantity", "value", "purchase", "gain", "gain_pct")}
    rows.orderBy(F.col("name") == TOTAL, "isin").withColumns(amounts).coalesce(1).write.csv(path, sep=";", header=True, quoteAll=True)


def bundle(**parts: DataFrame) -> DataFrame:
    """(part, pos, row as JSON) of several results, each in its order: what an analysis is given."""
    rows = []
    for name, df in parts.items():
        numbered = df.select(F.lit(name).alias("part"), F.monotonically_increasing_id().alias("pos"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        rows.append(numbered)
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out
