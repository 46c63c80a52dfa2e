"""From raw bookings to the enriched ledger: one pass, and the seam that loads and runs it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import enrich, pairing, versions
from tallyhouse.sources import canonical as C
from tallyhouse.sources.folders import stored as stored_

#: Columns of every canonical booking.
FIELDS = ["source", "external_id", "booking_date", "valuation_date", "amount", "currency", "sender", "recipient", "sender_iban", "recipient_iban", "description", "original_amount", "original_currency"]
#: Fixed value: words that name a wallet's postings at the bank.
WALLET_NAME = "paypal"
CARD_NAME = "santander"
_CARD = "id string, bookingDate string, valueDate string, merchant string, amount string, currency string, originalAmount string, originalCurrency string, cardLast4 string"
_CANONICAL = "external_id string, booking_date date, valuation_date date, amount decimal(14,2), currency string, sender string, recipient string, sender_iban string, recipient_iban string, description string, original_amount decimal(14,2), original_currency string"


class Normalised(NamedTuple):
    """The enriched ledger, links (parent_id, child_id, kind) and patterns of recurring payments."""

    ledger: DataFrame
    links: DataFrame
    patterns: DataFrame


def raw_rows(spark: SparkSession, payloads: list[str], source: str) -> DataFrame:
    """source, raw of payloads that are at hand as JSON."""
    return spark.createDataFrame([(source, p) for p in payloads], "source string, raw string")


def canonical(raw: DataFrame) -> DataFrame:
    """Canonical columns of ``raw`` (source, raw: JSON) by the adapter of each source, other columns kept. A source without one is an error, not a row that is lost."""
    kept = [c for c in raw.columns if c not in (*FIELDS, "raw")]
    known = F.coalesce(F.col("source").isin("bank", "card", "wallet"), F.lit(False))
    none = {"original_amount": F.lit(None).cast("decimal(14,2)"), "original_currency": F.lit(None).cast("string")}
    bank = C.bank(raw.where("source = 'bank'"), *kept).withColumns(none)
    card = C.card(raw.where("source = 'card'").withColumn("c", F.from_json("raw", _CARD)).select(*kept, "c.*"), *kept)
    wallet = raw.where("source = 'wallet'").withColumn("c", F.from_json(F.coalesce(F.get_json_object("raw", "$.canonical"), "raw"), _CANONICAL)).select("source", "c.*", *kept)
    # beside the others, so that each of those reads its own source from files; it has no rows
    strange = raw.where(F.when(known, F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("no adapter for source "), F.coalesce("source", F.lit("null")))).cast("boolean")))
    return bank.unionByName(card).unionByName(wallet).unionByName(strange.select("source", *kept), allowMissingColumns=True)


def replayed(records: DataFrame) -> DataFrame:
    """Bookings of records (source, canonical: struct of canonical columns): projected as they are, they hash as they did when they were read."""
    return C.content_hash(records.select("source", "canonical.*"))


def hash_changes(stored: DataFrame) -> DataFrame:
    """old, new of active rows (source, raw, content_hash, superseded_by) of the primary bank whose payload now makes another hash, each pair once however many rows share it; rows without a payload are left alone."""
    active = stored.where((F.col("source") == C.PRIMARY) & F.col("superseded_by").isNull() & F.get_json_object("raw", "$.source_payload").isNotNull())
    again = C.content_hash(C.bank(active.select(F.get_json_object("raw", "$.source_payload").alias("raw"), F.col("content_hash").alias("old")), "old"), "new")
    return again.where("old <> new").select("old", "new").distinct()


def frame(raw: DataFrame) -> DataFrame:
    """Active rows as an empty ledger: bookings without a day are left out, flags are off, nothing has a category. Rows whose column ``is_read`` is true have their canonical columns in the struct ``canonical`` and are not read again."""
    active = raw.where("superseded_by is null")
    if "is_read" in raw.columns:
        kept = [c for c in raw.columns if c not in (*FIELDS, "raw", "canonical", "is_read")]
        rows = active.where("is_read").select("source", "canonical.*", *kept).unionByName(canonical(active.where("not is_read").drop("canonical", "is_read")))
    else:
        rows = canonical(active)
    rows = rows.where("booking_date is not null")
    off = {f: F.lit(False) for f in ("is_recurring", "is_outlier", "internal_transfer", "is_refund")}
    return rows.withColumns({"id": F.col("content_hash"), "valuation_date": F.coalesce("valuation_date", "booking_date"), "category_id": F.lit(None).cast("string"), **off})


def _holds(word: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", "sender", "recipient", "description")), F.lit(word))


#: What the pass finds out about a booking.
FLAGS = ["internal_transfer", "is_recurring", "is_outlier"]


def normalised(raw: DataFrame, rules: list[tuple[str, str, int]], own_ibans: list[str]) -> Normalised:
    """The whole pass over ``raw`` (source, raw, content_hash, superseded_by): rules, transfers between own accounts, top-ups, collective debits and settlements, recurring payments, outliers.

    Parents of several bookings do not count themselves: they are marked as internal, what they are made of stays. Internal rows are no outliers and set no measure for them.
    """
    # the ledger is written once; steps hand on ids, and all flags are joined at the end
    ledger = stored_(enrich.apply_rules(frame(raw), rules).drop("matched"), "ledger")
    pairs = pairing.internal_transfers(ledger, own_ibans)
    own = stored_(pairs.select(F.explode(F.array("credit_id", "debit_id")).alias("id")), "internal")
    wallet, bank, card = F.col("source") == "wallet", F.col("source") == "bank", F.col("source") == "card"
    free = ledger.join(own, "id", "left_anti")
    top_ups = stored_(pairing.top_ups(free, wallet, bank & _holds(WALLET_NAME)), "top-ups")
    parents = free.where(bank & (F.col("amount") < 0) & _holds(WALLET_NAME)).join(top_ups.select(F.col("debit_id").alias("id")), "id", "left_anti").withColumn("account", F.lit("wallet"))
    details = free.where(wallet).join(top_ups.select(F.col("credit_id").alias("id")), "id", "left_anti").withColumn("account", F.lit("wallet"))
    sums = pairing.collective_debits(parents, details, "account")
    cycles = pairing.card_cycles(free.where(card))
    paid = pairing.settlements(cycles, free.where(bank & _holds(CARD_NAME)))
    months = free.where(card).select(F.col("id").alias("child_id"), F.trunc("booking_date", "MM").alias("cycle"))
    links = top_ups.select(F.col("debit_id").alias("parent_id"), F.col("credit_id").alias("child_id"), F.lit("top_up").alias("kind"))
    links = links.unionByName(sums.withColumn("kind", F.lit("collective"))).unionByName(paid.join(months, "cycle").select(F.col("debit_id").alias("parent_id"), "child_id", F.lit("settlement").alias("kind")))
    links = stored_(links, "links")
    internal = stored_(own.union(links.select("parent_id")).union(top_ups.select("credit_id")).distinct(), "internal")
    patterns, recurring = enrich.recurring(ledger)
    spent = ledger.join(internal, "id", "left_anti").select("id", "category_id", F.abs("amount").alias("spent"))
    far = enrich.outliers(spent, "category_id", "spent")
    hits = [ids.select("id", *[F.lit(flag == f).alias(f"_{f}") for f in FLAGS]) for ids, flag in ((internal, "internal_transfer"), (recurring, "is_recurring"), (far, "is_outlier"))]
    marked = reduce(DataFrame.union, hits).groupBy("id").agg(*[F.bool_or(f"_{f}").alias(f"_{f}") for f in FLAGS])
    marked = stored_(marked, "marked")
    flagged = ledger.join(marked, "id", "left").withColumns({f: F.col(f) | F.coalesce(f"_{f}", F.lit(False)) for f in FLAGS}).select(ledger.columns)
    return Normalised(flagged, links, patterns)


def ingested(stored: DataFrame, incoming: DataFrame, rules: list[tuple[str, str, int]], own_ibans: list[str]) -> tuple[DataFrame, Normalised]:
    """(versions, ledger) after ``incoming`` (source, raw, arrival) came to ``stored`` (source, external_id, content_hash, arrival, raw, version, superseded_by): what is new is versioned, then all is normalised."""
    rows = C.content_hash(canonical(incoming.withColumn("payload", F.col("raw"))))
    fresh = rows.select("source", "external_id", "content_hash", "arrival", F.col("payload").alias("raw"), F.struct(*FIELDS[1:]).alias("canonical"), F.lit(True).alias("is_read"))
    before = stored.withColumns({"canonical": F.lit(None).cast(fresh.schema["canonical"].dataType), "is_read": F.lit(False)})
    kept = stored_(versions.insert_versions(before, fresh), "versions")
    return kept.drop("canonical", "is_read"), normalised(kept, rules, own_ibans)
