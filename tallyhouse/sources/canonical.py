"""One transaction model for all sources, and its content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import remittance, strip_processor

#: Fields that make a transaction's identity.
IDENTITY = ("external_id", "booking_date", "valuation_date", "amount", "currency", "sender", "recipient", "sender_iban", "recipient_iban", "description")
DESCRIPTION_LIMIT = 500
PRIMARY = "bank"


def _at(raw: Column, *paths: str) -> Column:
    """The first of some JSON paths that holds something."""
    return F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])


def amount(text: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(text.cast("decimal(38,10)"), 2).cast("decimal(14,2)")


#: What a bank's booking may hold, as JSON; ``amount`` is a text or an object, read as text.
_BOOKING = {
    **dict.fromkeys(("transactionId", "transaction_id", "reference", "bookingDate", "booking_date", "valutaDate", "value_date", "valuation_date", "amount", "currency", "remittanceInfo", "remittance_info", "description"), "string"),
    **{f"{k}_{f}": "string" for k in ("remitter", "debtor", "creditor") for f in ("name", "iban")},
    **dict.fromkeys(("remitter", "debtor", "creditor"), "struct<holderName: string, name: string, iban: string>"),
    "transactionValue": "struct<value: string, unit: string>",
    "source_payload": "struct<reference: string>",
}


def _first(*fields: Column | str) -> Column:
    """The first of some fields that holds something."""
    return F.coalesce(*[F.nullif(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields])


def bank(rows: DataFrame, *kept: str) -> DataFrame:
    """Canonical columns of ``rows`` (raw: JSON of one booking), nested or flat, and those ``kept``; the counterparty is by sign, credits coming from the remitter.

    The JSON is read once a row, by a generator: Spark writes a column's expression out wherever the column is used, filters included, and would read it again for each of them.
    """
    read = F.from_json("raw", ", ".join(f"{k} {kind}" for k, kind in _BOOKING.items()), {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"})
    rows = rows.select(*kept, F.inline(F.array(read)).alias(*[f"_{k}" for k in _BOOKING]))
    part = lambda f: F.get_json_object("_amount", f"$.{f}")
    value = amount(_first("_transactionValue.value", part("value"), "_amount"))
    out = value < 0
    name = lambda *keys: _first(*(f"_{k}.{f}" for k in keys for f in ("holderName", "name")), *(f"_{k}_name" for k in keys))
    number = lambda *keys: _first(*(f"_{k}.iban" for k in keys), *(f"_{k}_iban" for k in keys))
    booked = F.to_date(F.left(_first("_bookingDate", "_booking_date"), F.lit(10)))
    return rows.select(
        F.lit(PRIMARY).alias("source"), _first("_transactionId", "_transaction_id", "_reference", "_source_payload.reference").alias("external_id"), booked.alias("booking_date"),
        F.coalesce(F.to_date(F.left(_first("_valutaDate", "_value_date", "_valuation_date"), F.lit(10))), booked).alias("valuation_date"), value.alias("amount"),
        F.coalesce(_first("_transactionValue.unit", part("unit"), "_currency"), F.lit("EUR")).alias("currency"),
        F.when(~out, name("remitter", "debtor")).alias("sender"), F.when(out, name("creditor")).alias("recipient"), F.when(~out, number("remitter", "debtor")).alias("sender_iban"), F.when(out, number("creditor")).alias("recipient_iban"),
        F.left(remittance(_first("_remittanceInfo", "_remittance_info", "_description")), F.lit(DESCRIPTION_LIMIT)).alias("description"), *kept)


def card(rows: DataFrame, *kept: str) -> DataFrame:
    """Canonical columns of card bookings and those ``kept``: merchant by sign, an id derived from the booking where there is none, the foreign amount only where the currency differs."""
    value = amount(F.col("amount").cast("string"))
    derived = F.concat(F.lit("card-"), F.left(F.sha2(F.concat_ws("|", "bookingDate", F.coalesce("valueDate", F.lit("")), "amount", F.lower("merchant"), "currency", "cardLast4"), 256), F.lit(16)))
    foreign = F.col("originalCurrency").isNotNull() & (F.col("originalCurrency") != F.col("currency"))
    booked = F.to_date("bookingDate")
    return rows.select(
        F.lit("card").alias("source"), F.coalesce(F.nullif("id", F.lit("")), derived).alias("external_id"), booked.alias("booking_date"), F.coalesce(F.to_date("valueDate"), booked).alias("valuation_date"), value.alias("amount"), "currency",
        F.when(value >= 0, F.col("merchant")).alias("sender"), F.when(value < 0, F.col("merchant")).alias("recipient"), F.lit(None).cast("string").alias("sender_iban"), F.lit(None).cast("string").alias("recipient_iban"), F.left("merchant", F.lit(DESCRIPTION_LIMIT)).alias("description"),
        F.when(foreign, amount(F.col("originalAmount").cast("string"))).alias("original_amount"), F.when(foreign, F.col("originalCurrency")).alias("original_currency"), *kept)


def accounts(rows: DataFrame) -> DataFrame:
    """account_id, iban, account_type, balance, currency of ``rows`` (raw: JSON of an account, nested or flat); what is missing is empty or 0."""
    raw = F.col("raw")
    kind = _at(raw, "$.account.accountType.key", "$.accountType.key", "$.account.accountType", "$.accountType")
    return rows.select(
        F.coalesce(_at(raw, "$.account.accountId", "$.accountId"), F.lit("")).alias("account_id"), F.coalesce(_at(raw, "$.account.iban", "$.iban"), F.lit("")).alias("iban"), kind.alias("account_type"),
        F.coalesce(amount(_at(raw, "$.balance.value", "$.balance")), F.lit(0).cast("decimal(14,2)")).alias("balance"), F.coalesce(_at(raw, "$.balance.unit"), F.lit("EUR")).alias("currency"))


def positions(rows: DataFrame) -> DataFrame:
    """isin, wkn, name, quantity, current_value, purchase_value, gains, gains_percent of ``rows`` (raw: JSON of a position): nested, flat or under German names; gains in per cent are 0 without a purchase value."""
    raw = F.col("raw")
    value = lambda *keys: F.coalesce(_at(raw, *(p for k in keys for p in (f"$.{k}.value", f"$.{k}"))).try_cast("decimal(38,10)"), F.lit(0))
    now, then = F.bround(value("currentValue", "kurswert"), 2).cast("decimal(18,2)"), F.bround(value("purchaseValue", "einstandswert"), 2).cast("decimal(18,2)")
    name = lambda k: F.coalesce(_at(raw, f"$.instrument.{k}", f"$.{k}"), F.lit(""))
    rows = rows.select(name("isin").alias("isin"), name("wkn").alias("wkn"), name("name").alias("name"), value("quantity", "stueckzahl").cast("decimal(18,6)").alias("quantity"), now.alias("current_value"), then.alias("purchase_value"))
    gain = (F.col("current_value") - F.col("purchase_value")).cast("decimal(18,2)")
    return rows.withColumns({"gains": gain, "gains_percent": F.when(F.col("purchase_value") == 0, 0.0).otherwise(F.round((gain * 100 / F.col("purchase_value")).cast("double"), 4))})


def wallet_name(name: Column) -> Column:
    return F.nullif(F.trim(strip_processor(name)), F.lit(""))


def content_hash(rows: DataFrame, column: str = "content_hash") -> DataFrame:
    """Adds the SHA-256 of the identity as compact JSON with sorted keys, non-ASCII characters escaped; rows of the primary bank hash their id as a null ``comdirect_id``."""
    text = lambda c: F.col(c).cast("string")

    def document(id_key: str, id_value: Column) -> Column:
        fields = {"amount": text("amount"), "booking_date": text("booking_date"), "currency": F.col("currency"), "description": F.col("description"), "recipient": F.col("recipient"), "recipient_iban": F.col("recipient_iban"), "sender": F.col("sender"), "sender_iban": F.col("sender_iban"), "valuation_date": text("valuation_date"), id_key: id_value}
        return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})

    whole = F.when(F.col("source") == PRIMARY, document("comdirect_id", F.lit(None).cast("string"))).otherwise(document("external_id", text("external_id")))
    text = rows.select("*", F.explode(F.array(whole)).alias("_identity"))  # a generator, so that a filter on the hash does not write all of it out again
    return text.withColumn(column, F.sha2(_escaped(F.col("_identity")), 256)).drop("_identity")


def _escaped(text: Column) -> Column:
    """``\\uXXXX`` for every character beyond ASCII, by its UTF-16 units."""
    units = F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "$1 "), " ")
    one = lambda u: F.when(u == "", "").when(F.startswith(u, F.lit("00")) & (u < "0080"), F.char(F.conv(u, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
    return F.when(F.length(text) < F.octet_length(text), F.array_join(F.transform(units, one), "")).otherwise(text)
