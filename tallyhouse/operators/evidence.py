"""Evidence from mails, and which ledger row it proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as T
from tallyhouse.functions.numbers import cents
from tallyhouse.operators.versions import upsert
from tallyhouse.sources.folders import stored as written

#: Patterns of a mail's fields, the first that fits counting.
MERCHANT = [r"^\s*(?:merchant|händler|shop|vendor)\s*:\s*(.+)$", r"^\s*(?:from|von)\s*:\s*(.+)$"]
AMOUNT = [
    r"^\s*(?:total|betrag|summe|amount)\s*:\s*(?:EUR|€)?\s*(-?\d+[\d.,]*)",
    r"^\s*(?:total|betrag|summe|amount)\s*:\s*(-?\d+[\d.,]*)\s*(?:EUR|€)",
    r"^\s*(?:gesamtbetrag|rechnungsbetrag|offener betrag)(?:\s+inkl\.\s+mwst\.)?\s*:\s*(-?\d+[\d.,]*)\s*(?:EUR|€)",
    r"\b(?:betrag|summe|gesamtbetrag|rechnungsbetrag)\s+von\s*(-?\d+[\d.,]*)\s*(?:EUR|€)",
    r"\b(?:offener betrag|gesamtbetrag|rechnungsbetrag)(?:\s+inkl\.\s+mwst\.)?\s*:\s*(-?\d+[\d.,]*)\s*(?:EUR|€)",
]
DATE = [r"^\s*(?:date|datum|order date|bestelldatum)\s*:\s*([0-9./-]+)"]
ORDER = [r"^\s*(?:order|bestellnummer|bestellung|invoice|rechnung)\s*:\s*(.+)$", r"\b(?:order|bestellnummer|bestellung|invoice|rechnung)[\s:#-]+([A-Z0-9._/-]{4,})\b"]
PAYMENT = [r"^\s*(?:payment|zahlung|zahlungsart)\s*:\s*(.+)$"]
CURRENCY = [r"\b(EUR|USD|GBP|CHF)\b"]


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, f"(?imu){p}", 1)), F.lit("")) for p in patterns])


def extracted(messages: DataFrame) -> DataFrame:
    """Evidence drafts of ``messages`` (source, source_message_id, received_at, sender, subject, body_text): no personal data, references only as digests.

    Confidence grows with each field that the text itself holds; the day of receipt stands in for a missing date, but earns nothing.
    """
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body_text", F.lit(""))
    m = messages.withColumns({"text": F.concat(subject, F.lit("\n"), body), "from": F.coalesce(F.nullif("source", F.lit("")), F.lit("gmail"))})
    text = F.col("text")
    sender = F.split(F.coalesce("sender", F.lit("")), "@")[0]
    m = m.withColumns({
        "merchant": F.coalesce(_first(text, MERCHANT), sender), "signed": T.mixed_decimal(_first(text, AMOUNT)), "currency": F.upper(F.coalesce(_first(text, CURRENCY), F.lit("EUR"))), "written": T.any_date(_first(text, DATE)),
        "order_ref": _first(text, ORDER), "payment_method": T.payment_method(text), "payment_hint": T.redact(_first(text, PAYMENT), 200), "evidence_type": T.evidence_type(text), "line_items": T.line_items(body), "subject_hint": T.redact(subject, 200), "redacted_snippet": T.redact(body, 500),
    })
    m = m.withColumn("merchant_name", T.redact(F.col("merchant"), 200))
    m = m.withColumns({"merchant_key": T.merchant_key(F.col("merchant_name")), "order_ref_hash": T.reference_hash(F.col("order_ref")), "document_date": F.coalesce("written", "received_at")})
    message = F.coalesce(F.nullif("source_message_id", F.lit("")), F.nullif(subject, F.lit("")), body)
    identity = F.concat_ws("|", "from", F.coalesce("order_ref_hash", T.reference_hash(message)), "evidence_type", F.coalesce(F.when(F.col("signed") != 0, F.col("signed").cast("string")), F.lit("")), F.coalesce(F.col("written").cast("string"), F.lit("")))
    weights = (("merchant_name", 20), ("signed", 25), ("written", 15), ("order_ref", 15), ("payment_method", 10))
    score = F.lit(10) + sum((F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in weights), F.when(F.size("line_items") > 0, 5).otherwise(0))
    return m.select(
        F.concat(F.lit("mail_"), F.left(T.reference_hash(identity), F.lit(24))).alias("evidence_id"), F.col("from").alias("source"), "evidence_type", "merchant_name", "merchant_key", "document_date", F.abs("signed").alias("total_amount"), "currency", "payment_method", "payment_hint", "order_ref_hash", "subject_hint",
        "redacted_snippet", "line_items", message.alias("message"), F.least(score / 100, F.lit(0.999)).cast("decimal(4,3)").alias("confidence"))


def usable(drafts: DataFrame, least: float = 0.5) -> DataFrame:
    return drafts.where(F.col("total_amount").isNotNull() & (F.col("confidence") >= least))


def upsert_evidence(stored: DataFrame, drafts: DataFrame, order: str) -> DataFrame:
    """``stored`` with ``drafts`` put in: a draft is the stored row of its evidence_id, else that of its source, order_ref_hash and type, else that of the first such draft; of several for a row the last in ``order`` counts. Ids never change."""
    keys = ["source", "order_ref_hash", "evidence_type"]
    by_id = stored.select("evidence_id", F.col("evidence_id").alias("same_id"))
    by_key = stored.where("order_ref_hash is not null").groupBy(keys).agg(F.min("evidence_id").alias("same_key"))
    first = drafts.where("order_ref_hash is not null").groupBy(keys).agg(F.min_by("evidence_id", order).alias("first_id"))
    placed = drafts.join(by_id, "evidence_id", "left").join(by_key, keys, "left").join(first, keys, "left")
    placed = placed.withColumn("evidence_id", F.coalesce("same_id", "same_key", "first_id", "evidence_id"))
    columns = [c for c in stored.columns if c != "evidence_id"]
    latest = placed.groupBy("evidence_id").agg(F.max_by(F.struct(*columns), order).alias("d")).select("evidence_id", "d.*")
    return upsert(stored, latest, ["evidence_id"])


#: Rows of one amount and run of days that a task joins at most.
MOST_ROWS = 4096


def match_scores(evidence: DataFrame, ledger: DataFrame, within: int = 7, least: int = 650, most_rows: int = MOST_ROWS) -> DataFrame:
    """Ledger rows that each evidence may prove, with a score in thousandths and its reasons, as links.

    Equal cents and at most ``within`` days apart; refunds prove credits, everything else debits. The join is on cents and
    runs of days as long as the window, of which an evidence lies in two at most and a row in one. Amounts of which a run
    has more than ``most_rows`` are split over tasks, each with a share of the rows and all the evidence.
    """
    run = lambda day: F.floor(F.unix_date(day) / (2 * within + 1))
    e = evidence.select("evidence_id", "evidence_type", "merchant_key", "payment_method", "document_date", F.abs(cents(F.col("total_amount"))).alias("cents"))
    e = e.withColumn("run", F.explode(F.array_distinct(F.array(run(F.date_sub("document_date", within)), run(F.date_add("document_date", within))))))
    hay = T.merchant_key(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("sender", "recipient", "description")]))
    t = ledger.where(~F.col("internal_transfer")).select("id", "booking_date", "amount", F.abs(cents(F.col("amount"))).alias("cents"), F.coalesce(hay, F.lit("")).alias("hay"), run(F.col("booking_date")).alias("run"))
    t = written(t, "booked")  # read twice
    hot = t.groupBy("cents", "run").count().where(F.col("count") > most_rows).select("cents", "run", F.ceil(F.col("count") / most_rows).alias("shares"))
    t = t.join(hot, ["cents", "run"], "left").withColumn("share", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1)))).drop("shares")
    e = e.join(hot, ["cents", "run"], "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    away = F.abs(F.datediff("booking_date", "document_date"))
    pairs = e.join(t, ["cents", "run", "share"]).where(away <= within)
    pairs = pairs.where(F.when(F.col("evidence_type") == "refund", F.col("amount") > 0).otherwise(F.col("amount") < 0))
    tokens = F.filter(F.split("merchant_key", " "), lambda x: F.length(x) >= 4)
    holds = lambda c: F.contains(F.col("hay"), c)
    named = F.coalesce(F.exists(tokens, holds), F.lit(False))
    paid = F.coalesce(holds(F.col("payment_method")) | ((F.col("payment_method") == "credit_card") & (holds(F.lit("visa")) | holds(F.lit("mastercard")) | holds(F.lit("santander")))), F.lit(False))
    reasons = F.concat_ws("+", F.lit("amount"), F.when(away <= 1, "date<=1d").when(away <= 5, "date<=5d"), F.when(named, "merchant"), F.when(paid, "payment_method"))
    score = F.lit(550) + F.when(away <= 1, 150).when(away <= 5, 80).otherwise(0) + F.when(named, 200).otherwise(0) + F.when(paid, 100).otherwise(0)
    kind = F.concat("evidence_type", F.lit("_match"))
    link = F.concat(F.lit("evlink_"), F.left(T.reference_hash(F.concat_ws("|", "id", "evidence_id", kind)), F.lit(24)))
    return pairs.select("evidence_id", "id", kind.alias("match_type"), F.least(score, F.lit(999)).cast("bigint").alias("score"), reasons.alias("reasons"), link.alias("link_id")).where(F.col("score") >= least)


def upsert_links(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Links by their id: a link that is found again takes the new score and reasons."""
    return upsert(stored, found, ["link_id"], fixed=["evidence_id", "id", "match_type"])


def imported(messages: DataFrame, stored: DataFrame, links: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, links) after ``messages``, extracted, put in and matched to the ledger. Drafts without an amount or of little confidence stay out. Messages count in the order of their source_message_id."""
    drafts = usable(written(extracted(messages), "drafts"))  # written first: the filter would have the texts read twice
    evidence = written(upsert_evidence(stored, drafts, "message"), "evidence")
    keys = ["source", "order_ref_hash", "evidence_type"]
    come = evidence.join(drafts.select("evidence_id").distinct(), "evidence_id", "left_semi").unionByName(evidence.join(drafts.select(keys).distinct(), keys, "left_semi")).dropDuplicates(["evidence_id"])
    return evidence, upsert_links(links, match_scores(come, ledger))


def top_debits(ledger: DataFrame, categories: DataFrame, links: DataFrame, evidence: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest debits with category and evidence; a row with several pieces of evidence comes once for each."""
    proof = links.select("id", "evidence_id", F.col("score").alias("evidence_score")).join(evidence.select("evidence_id", "evidence_type", "merchant_name"), "evidence_id", "left")
    rows = ledger.where("amount < 0 and not internal_transfer").join(categories, "category_id", "left").join(proof, "id", "left")
    return rows.orderBy("amount", "id", F.col("evidence_id").asc_nulls_first()).limit(n).select("id", "booking_date", "amount", "name", "evidence_id", "evidence_type", "merchant_name", "evidence_score")


def newest(evidence: DataFrame, start: str | None = None, end: str | None = None, n: int = 100) -> DataFrame:
    """The latest documents, of a period or of all time; those without a date last."""
    rows = evidence if start is None else evidence.where(F.col("document_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows.orderBy(F.desc_nulls_last("document_date"), "evidence_id").limit(n)
