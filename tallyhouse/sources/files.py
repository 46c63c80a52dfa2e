"""Readers of exports and statements, writers of reports."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.text import german_decimal, html_text
from tallyhouse.sources.canonical import DESCRIPTION_LIMIT, wallet_name

#: Headers of a wallet's statement, lower case, and what they are called here; those without which no row can be read.
WALLET_HEADERS = {
    "datum": "date",
    "beschreibung": "description_type",
    "währung": "currency",
    "brutto": "gross",
    "entgelt": "fee",
    "gebühr": "fee",
    "netto": "net",
    "guthaben": "balance",
    "transaktionscode": "transaction_id",
    "name": "name",
    "bankkonto": "bank_account",
    "rechnungsnummer": "invoice_number",
    "zugehöriger transaktionscode": "related_transaction_id",
}
WALLET_REQUIRED = ("date", "transaction_id", "gross", "currency", "name")
WALLET_MOST_ROWS = 200_000
CONVERSION, FUNDING = "allgemeine währungsumrechnung", "bankgutschrift auf paypal-konto"
#: Lines of a card statement.
MONEY = r"\d{1,3}(?:\.\d{3})*,\d{2}"
STATEMENT_DATE, LAST_FOUR = r"Rechnungsdatum\s+(\d{2}\.\d{2}\.\d{4})", r"\*{4,}\s*(\d{4})"
OPENING, CLOSING = rf"^SALDOVORTRAG\s+({MONEY})(\s+H)?\s*$", rf"^NEUER SALDO IN EURO\s+({MONEY})(\s+H)?\s*$"
FEE = rf"^(FINANZIERUNGSGEBÜHR|VERZUGSZINSEN|SOLLZINSEN|MAHNGEBÜHR)\s+({MONEY})(\s+H)?\s*$"
BOOKING = rf"^(\d{{4}})\s+(.+?)\s+(\d{{4}})\s+({MONEY})(\s+H)?$"
FOREIGN = rf"^(.+?)\s+([A-Z]{{3}})\s+({MONEY})\s+(\d+\.\d{{3,}})$"


def json_export(spark: SparkSession, path: str) -> DataFrame:
    """account_id and raw (JSON) of each booking of exports ``{"transactions": {account: [booking, ...]}}``."""
    whole = spark.read.text(path, wholetext=True)
    accounts = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.transactions"), "map<string,string>")).alias("account_id", "list"))
    each = accounts.select("account_id", F.explode(F.variant_get(F.parse_json("list"), "$", "array<variant>")).alias("v"))
    return each.select("account_id", F.to_json("v").alias("raw"))


#: Fixed value: how many characters of a file tell its dialect.
SNIFFED = 4096


def separator(head: str) -> str:
    """What separates the fields of a CSV that begins with ``head``: of comma and semicolon the one that stands equally often, outside of quotes, in most of its lines; a comma where neither does. A last line that was cut does not count, and quotes may hold line ends."""
    cut = len(head) >= SNIFFED
    bare = re.sub(r'"[^"]*(?:"|$)', "", head)
    lines = [line for line in bare.split("\n") if line.strip()]
    lines = lines[:-1] if cut and len(lines) > 1 else lines
    best, most = ",", (0, 0)
    for sep in ",;":
        counts = Counter(n for line in lines if (n := line.count(sep)))
        # of equally many lines the larger count decides, as decimals hold commas too
        found = max(((k, c) for c, k in counts.items()), default=(0, 0))
        if found > most:
            best, most = sep, found
    return best


def wallet_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a wallet's CSV under this engine's names. The separator is that of the header; columns are found by name; a missing one is an error that names it."""
    if broken := spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path").take(1):
        raise ValueError(f"not UTF-8: {broken[0][0]}")
    head = "\n".join(r[0] for r in spark.read.text(path).limit(SNIFFED).collect())[:SNIFFED]
    if not head.strip():
        raise ValueError("the statement is empty")
    sep = separator(head)
    raw = spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", multiLine=True, escape='"')
    names: dict[str, str] = {}
    for c in raw.columns:
        key = WALLET_HEADERS.get(c.lstrip("﻿").strip().strip('"').lower())
        if key and key not in names:
            names[key] = c
    if missing := [k for k in WALLET_REQUIRED if k not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    rows = raw.select(*[F.trim(F.col(f"`{names[k]}`")).alias(k) if k in names else F.lit(None).cast("string").alias(k) for k in dict.fromkeys(WALLET_HEADERS.values())], F.monotonically_increasing_id().alias("line"))
    rows = rows.where(F.exists(F.array(*[F.coalesce(k, F.lit("")) for k in rows.columns if k != "line"]), lambda x: x != ""))
    if rows.limit(WALLET_MOST_ROWS + 1).count() > WALLET_MOST_ROWS:
        raise ValueError(f"the statement has more than {WALLET_MOST_ROWS} rows")
    return rows


def conversion_legs(rows: DataFrame) -> DataFrame:
    """related_transaction_id and the euro amount that its foreign payment was booked with, the last leg counting."""
    legs = rows.where((F.lower("description_type") == CONVERSION) & (F.col("currency") == "EUR") & (F.col("related_transaction_id") != ""))
    return legs.withColumn("eur", german_decimal(F.col("gross"))).where("eur is not null").groupBy("related_transaction_id").agg(F.max_by("eur", "line").alias("eur"))


def is_payment(name: Column, kind: Column) -> Column:
    """Real payments and money from the bank; not the wallet's own bookings."""
    return ((F.coalesce(name, F.lit("")) != "") & ~F.contains(F.lower(name), F.lit("paypal"))) | F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit(FUNDING))


def wallet(rows: DataFrame) -> DataFrame:
    """Canonical columns of a wallet's rows: foreign payments in euros by their conversion leg, the original amount kept."""
    legs = conversion_legs(rows).withColumnRenamed("related_transaction_id", "transaction_id")
    paid = rows.where(is_payment(F.col("name"), F.col("description_type"))).join(legs, "transaction_id", "left")
    gross, foreign = german_decimal(F.col("gross")), (F.col("currency") != "EUR") & F.col("eur").isNotNull()
    paid = paid.withColumns({"value": F.when(foreign, F.col("eur")).otherwise(gross), "who": wallet_name(F.col("name")), "day": F.to_date("date", "dd.MM.yyyy"), "foreign": foreign})
    return paid.select(
        F.lit("wallet").alias("source"), F.col("transaction_id").alias("external_id"), F.col("day").alias("booking_date"), F.col("day").alias("valuation_date"), F.col("value").alias("amount"), F.when(F.col("foreign"), "EUR").otherwise(F.col("currency")).alias("currency"),
        F.when(F.col("value") >= 0, F.col("who")).alias("sender"), F.when(F.col("value") < 0, F.col("who")).alias("recipient"), F.lit(None).cast("string").alias("sender_iban"), F.lit(None).cast("string").alias("recipient_iban"),
        F.left(F.coalesce("who", F.nullif("description_type", F.lit(""))), F.lit(DESCRIPTION_LIMIT)).alias("description"), F.when(F.col("foreign"), gross).alias("original_amount"), F.when(F.col("foreign"), F.col("currency")).alias("original_currency"))


def statement_day(ddmm: Column, statement: Column) -> Column:
    """A day without a year is of the statement's year, or the one before if its month is later."""
    d, m = F.left(ddmm, F.lit(2)).cast("int"), F.right(ddmm, F.lit(2)).cast("int")
    year = F.year(statement) - (m > F.month(statement)).cast("int")
    return F.try_to_date(F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def card_statement(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bookings, balances) of ``texts`` (file, text), the text of card statements.

    Only lines between the opening and the closing balance count; a trailing H is a credit. A booking's external_id is a digest that tells equal rows apart by their order.
    ``balances`` says for each file whether opening less bookings is closing; a file's bookings are worth taking only then.
    """
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    part = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    signed = lambda p, k, h: german_decimal(part(p, k)) * F.when(part(p, h).isNotNull(), -1).otherwise(1)
    head = lines.groupBy("file").agg(
        F.to_date(F.max(part(STATEMENT_DATE, 1)), "dd.MM.yyyy").alias("statement"), F.max(part(LAST_FOUR, 1)).alias("last_four"), F.min(F.when(F.col("line").rlike(OPENING), F.col("pos"))).alias("first"), F.max(F.when(F.col("line").rlike(CLOSING), F.col("pos"))).alias("end"),
        F.max(signed(OPENING, 1, 2)).alias("opening"), F.max(signed(CLOSING, 1, 2)).alias("closing"))
    inside = lines.join(head, "file").where("pos > first and pos < end")
    rows = inside.withColumn("fee", F.col("line").rlike(FEE)).where(F.col("fee") | F.col("line").rlike(BOOKING))
    middle = part(BOOKING, 2)
    rows = rows.withColumn("middle", middle).withColumns({
        "booking_date": F.when(F.col("fee"), F.col("statement")).otherwise(statement_day(part(BOOKING, 1), F.col("statement"))), "purchase_date": F.when(~F.col("fee"), statement_day(part(BOOKING, 3), F.col("statement"))),
        "amount": F.when(F.col("fee"), -signed(FEE, 2, 3)).otherwise(-signed(BOOKING, 4, 5)).cast("decimal(14,2)"), "merchant": F.coalesce(F.when(F.col("fee"), part(FEE, 1)), F.nullif(F.regexp_extract("middle", FOREIGN, 1), F.lit("")), F.col("middle")),
        "original_currency": F.nullif(F.regexp_extract("middle", FOREIGN, 2), F.lit("")), "original_amount": german_decimal(F.nullif(F.regexp_extract("middle", FOREIGN, 3), F.lit(""))),
    })
    identity = F.concat_ws("|", "statement", "booking_date", F.coalesce(F.col("purchase_date").cast("string"), F.lit("")), "amount", F.lower("merchant"), F.coalesce("original_currency", F.lit("EUR")), F.coalesce("last_four", F.lit("")))
    rows = rows.withColumn("identity", identity).withColumn("occurrence", F.row_number().over(W.Window.partitionBy("file", "identity").orderBy("pos")) - 1)
    rows = rows.withColumn("external_id", F.left(F.sha2(F.concat_ws("|", "identity", "occurrence"), 256), F.lit(16)))
    bookings = rows.select("file", "external_id", "booking_date", "purchase_date", "amount", "merchant", "original_amount", "original_currency", "last_four")
    sums = bookings.groupBy("file").agg(F.sum("amount").alias("booked"))
    balances = head.join(sums, "file", "left").select("file", "opening", "closing", F.coalesce("booked", F.lit(0)).cast("decimal(14,2)").alias("booked"), F.coalesce(F.col("opening") - F.coalesce("booked", F.lit(0)) == F.col("closing"), F.lit(False)).alias("balanced"))
    return bookings, balances


#: Files, bytes of a file and bytes of all that one import takes at most.
MOST_FILES, MOST_BYTES, MOST_TOTAL = 24, 10 * 1024 * 1024, 50 * 1024 * 1024


def card_statements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bookings, errors) of the text files of card statements at ``path``: a file that is too large, no statement, or whose bookings do not add up is told of in errors (file, error), and the others count. Spark passes over files without a byte.

    More files or bytes than an import takes are an error of the whole, and so is an import without any statement.
    """
    found = spark.read.format("binaryFile").load(path)
    totals = found.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    if totals["n"] > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    if (totals["bytes"] or 0) > MOST_TOTAL:
        raise ValueError(f"more than {MOST_TOTAL} bytes")
    size = F.when(F.col("length") > MOST_BYTES, "the file is too large")
    texts = found.select(F.col("path").alias("file"), size.alias("error"), F.when(size.isNull(), F.col("content").cast("string")).alias("text"))
    bookings, balances = card_statement(texts.where("error is null").select("file", "text"))
    checked = texts.select("file", "error").join(balances.select("file", "opening", "closing", "balanced"), "file", "left")
    verdict = F.coalesce("error", F.when(F.col("opening").isNull() | F.col("closing").isNull(), "not a statement"), F.when(~F.col("balanced"), "opening, bookings and closing do not agree"))
    checked = checked.select("file", verdict.alias("error"))
    if not checked.where("error is null").take(1):
        raise ValueError("; ".join(f"{r['file']}: {r['error']}" for r in checked.orderBy("file").collect()) or "no statement")
    return bookings.join(checked.where("error is null").select("file"), "file", "left_semi"), checked.where("error is not null")


def wallet_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``file``, errors) of a wallet's CSV files at ``path``: each has its own dialect, and one that is too large, not UTF-8, without a needed column or too long is told of in errors (file, error) while the others count.

    More files or bytes than an import takes are an error of the whole, and so is an import without any statement. The driver lists at most that many files; their rows stay in Spark.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    totals = found.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    if totals["n"] > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    if (totals["bytes"] or 0) > MOST_TOTAL:
        raise ValueError(f"more than {MOST_TOTAL} bytes")
    rows, errors = None, []
    for file, length in sorted(map(tuple, found.collect())):
        try:
            if length > MOST_BYTES:
                raise ValueError("the file is too large")
            one = wallet_rows(spark, file).withColumn("file", F.lit(file))
            rows = one if rows is None else rows.unionByName(one)
        except ValueError as error:
            errors.append((file, str(error)))
    if rows is None:
        raise ValueError("; ".join(f"{file}: {error}" for file, error in errors) or "no statement")
    return rows, spark.createDataFrame(errors, "file string, error string")


def mail_messages(rows: DataFrame) -> DataFrame:
    """source, source_message_id, received_at, sender, subject, body_text of ``rows`` with a URL-safe base64 ``body`` or ``html``."""
    plain = F.unbase64(F.translate("body", "-_", "+/")).cast("string")
    return rows.select("source", "source_message_id", "received_at", "sender", "subject", F.coalesce(F.nullif(F.trim(plain), F.lit("")), html_text(F.col("html"))).alias("body_text"))


def prices(spark: SparkSession, path: str, currency: str = "EUR") -> DataFrame:
    """Daily closes (isin, date, close, currency) of CSV files, ascending; rows of another currency are left out."""
    rows = spark.read.csv(path, header=True, schema="isin string, date date, close decimal(14,4), currency string")
    return rows.where((F.col("currency") == currency) & F.col("close").isNotNull()).orderBy("isin", "date")


def write_statement(ledger: DataFrame, path: str) -> None:
    """Bookings as a German CSV: semicolons, everything quoted, dates and amounts as written there."""
    out = ledger.select(F.date_format("booking_date", "dd.MM.yyyy").alias("Buchungstag"), F.date_format("valuation_date", "dd.MM.yyyy").alias("Wertstellung"), F.concat_ws(" ", F.coalesce("recipient", "sender"), "description").alias("Text"), F.translate(F.format_number("amount", 2), ",.", ".,").alias("Betrag"))
    out.write.csv(path, sep=";", header=True, quoteAll=True)


def write_json(ledger: DataFrame, path: str) -> None:
    ledger.write.json(path)
