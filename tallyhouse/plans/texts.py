"""Text, dates, statements and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import numbers, text
from tallyhouse.plans.registry import query
from tallyhouse.sources import canonical, files
from tallyhouse.sources.tables import LEDGER, Tables

_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_ROWS = "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(14,2)) AS bal FROM customer"


def _rows(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(14,2)").alias("bal"))


_NOTE = "'Mail a' || k || '@mail.example.com about Order: AB-' || (k + 1000) || ' and DE' || lpad(CAST(k AS VARCHAR), 20, '0') || ' ref ' || (k * 7919 + 10000000) || ' Bearer abcdefgh' || k || '  tel ' || (k + 123456789)"


def _note() -> F.Column:
    k = F.col("k")
    s = lambda c: c.cast("string")
    return F.concat(F.lit("Mail a"), s(k), F.lit("@mail.example.com about Order: AB-"), s(k + 1000), F.lit(" and DE"), F.lpad(s(k), 20, "0"), F.lit(" ref "), s(k * 7919 + 10000000), F.lit(" Bearer abcdefgh"), s(k), F.lit("  tel "), s(k + 123456789))


def _chain(x: str, rules: list[tuple[str, str]], limit: int) -> str:
    for pattern, mark in rules:
        x = f"regexp_replace({x}, '{pattern}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    return f"left(trim(regexp_replace({x}, '\\s+', ' ', 'g')), {limit})"


@query(f"WITH r AS (SELECT k, {_NOTE} AS note FROM ({_ROWS})) SELECT k, nullif({_chain('note', text.REDACTIONS, 500)}, '') AS redacted FROM r")
def redact_text(t: Tables) -> DataFrame:
    return _rows(t).select("k", text.redact(_note()).alias("redacted"))


_UNSAFE = " OR ".join(f"regexp_matches(%s, '{p}')" for p, _ in text.SANITISERS)


@query(f"WITH r AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'nothing to hide' ELSE {_NOTE} END AS note FROM ({_ROWS})), c AS (SELECT k, note, {_chain('note', text.SANITISERS, 300)} AS clean FROM r) SELECT k, clean, {_UNSAFE.replace('%s', 'note')} AS unsafe_before, {_UNSAFE.replace('%s', 'clean')} AS unsafe FROM c")
def sanitise_text(t: Tables) -> DataFrame:
    rows = _rows(t).select("k", F.when(F.col("k") % 3 == 0, "nothing to hide").otherwise(_note()).alias("note")).withColumn("clean", text.sanitise(F.col("note")))
    return rows.select("k", "clean", text.is_unsafe(F.col("note")).alias("unsafe_before"), text.is_unsafe(F.col("clean")).alias("unsafe"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{_EMAIL}', '[email]', 'g'), '[ \\n\\r\\t]+', ' ', 'g')) AS clean FROM documents")
def mail_addresses(t: Tables) -> DataFrame:
    """Documents without mail addresses."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", _EMAIL, "[email]"), r"[ \n\r\t]+", " "))
    return t.raw("documents").select("doc_id", clean.alias("clean"))


_SHOP = "CASE k % 4 WHEN 0 THEN 'PayPal *' || name || ' GmbH' WHEN 1 THEN 'ACME ' || segment || ' Payments Ltd' WHEN 2 THEN 'pp*Shop-' || k ELSE '  ' END"


@query(f"SELECT k, nullif(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({_SHOP}), 'paypal *', ' '), '{text.LEGAL_FORMS}', ' ', 'g'), '[^a-z0-9äöüß]+', ' ', 'g'), '\\s+', ' ', 'g')), '') AS merchant_key, regexp_replace({_SHOP}, '(?i)^\\s*(?:paypal|pp)\\s*\\*\\s*', '') AS bare FROM ({_ROWS})")
def merchant_key(t: Tables) -> DataFrame:
    k = F.col("k")
    shop = F.when(k % 4 == 0, F.concat(F.lit("PayPal *"), "name", F.lit(" GmbH"))).when(k % 4 == 1, F.concat(F.lit("ACME "), "segment", F.lit(" Payments Ltd"))).when(k % 4 == 2, F.concat(F.lit("pp*Shop-"), k.cast("string"))).otherwise("  ")
    return _rows(t).select("k", text.merchant_key(shop).alias("merchant_key"), text.strip_processor(shop).alias("bare"))


_MAIL = "CASE k % 6 WHEN 0 THEN 'Your refund via PayPal' WHEN 1 THEN 'Subscription paid by VISA' WHEN 2 THEN 'Kassenbon, Lastschrift' WHEN 3 THEN 'Rechnung, payment method: invoice' WHEN 4 THEN 'refunds are not refundable' ELSE 'Bestellung' END"


@query(f"SELECT k, CASE k % 6 WHEN 0 THEN 'refund' WHEN 1 THEN 'subscription' WHEN 2 THEN 'receipt' WHEN 3 THEN 'invoice' ELSE 'order' END AS kind, CASE k % 6 WHEN 0 THEN 'paypal' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'direct_debit' WHEN 3 THEN 'invoice' END AS method FROM ({_ROWS})")
def evidence_kinds(t: Tables) -> DataFrame:
    k = F.col("k") % 6
    mail = F.when(k == 0, "Your refund via PayPal").when(k == 1, "Subscription paid by VISA").when(k == 2, "Kassenbon, Lastschrift").when(k == 3, "Rechnung, payment method: invoice").when(k == 4, "refunds are not refundable").otherwise("Bestellung")
    return _rows(t).select("k", text.evidence_type(mail).alias("kind"), text.payment_method(mail).alias("method"))


@query(f"SELECT k, bal AS parsed, replace(replace(replace(format('{{:,.2f}}', CAST(bal AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' EUR' AS written, CAST(k * 1000000 AS DECIMAL(14,2)) AS thousands FROM ({_ROWS})")
def german_numbers(t: Tables) -> DataFrame:
    """Amounts written as in German, and read back."""
    written = text.german_money(F.col("bal"))
    points = F.concat(F.col("k").cast("string"), F.lit(".000.000"))
    rows = _rows(t).select("k", written.alias("written"), points.alias("p"))
    return rows.select("k", text.german_decimal(F.replace("written", F.lit(" EUR"), F.lit(""))).alias("parsed"), "written", text.german_decimal(F.col("p")).alias("thousands"))


@query(f"SELECT k, rpad(name, 35, 'x') || ', ' || segment AS cleaned FROM ({_ROWS})")
def remittance_text(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("01"), F.rpad("name", 35, "x"), F.lit("02"), F.rpad("segment", 35, " "))
    return _rows(t).select("k", text.remittance(raw).alias("cleaned"))


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN 'DE' || lpad(CAST(k AS VARCHAR), 20, '0') END AS iban, CASE WHEN length(name || name || name) > 50 THEN left(name || name || name, 47) || '...' ELSE name || name || name END AS short, sha256(lower(trim(name))) AS ref FROM ({_ROWS})")
def identifiers(t: Tables) -> DataFrame:
    k = F.lpad(F.col("k").cast("string"), 20, "0")
    number = F.when(F.col("k") % 2 == 0, F.concat(F.lit("de "), k)).otherwise(F.concat(F.lit("12 "), k))
    return _rows(t).select("k", text.iban(number).alias("iban"), text.shortened(F.concat("name", "name", "name")).alias("short"), text.reference_hash(F.col("name")).alias("ref"))


_DAY = "DATE '2019-12-20' + CAST(k % 900 AS INTEGER)"


@query(f"""WITH d AS (SELECT k, CAST({_DAY} AS DATE) AS d, CASE k % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' ELSE 'anomaly' END AS kind, CASE WHEN k % 2 = 0 THEN CAST(k % 20 + 1 AS INTEGER) END AS n FROM ({_ROWS})),
s AS (SELECT *, CASE WHEN n IS NULL AND kind = 'weekly' THEN CAST(date_trunc('week', d) AS DATE) WHEN n IS NULL AND kind = 'monthly' THEN CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) WHEN n IS NULL THEN d - 30 WHEN kind = 'anomaly' THEN d - n ELSE d - (n - 1) END AS start FROM d)
SELECT k, start, CASE WHEN n IS NULL AND kind = 'weekly' THEN start + 6 WHEN n IS NULL AND kind = 'monthly' THEN last_day(start) ELSE d END AS "end",
       CASE WHEN n IS NULL AND kind = 'weekly' THEN isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') WHEN n IS NULL AND kind = 'monthly' THEN strftime(start, '%Y-%m') ELSE strftime(start, '%Y-%m-%d') || '/' || strftime(d, '%Y-%m-%d') END AS label, true AS read_back FROM s""")  # fmt: skip
def report_periods(t: Tables) -> DataFrame:
    """Labels of reports and their days, each label read back."""
    k = F.col("k")
    kind = F.when(k % 3 == 0, "weekly").when(k % 3 == 1, "monthly").otherwise("anomaly")
    days = F.when(k % 2 == 0, (k % 20 + 1).cast("int"))
    rows = _rows(t).select("k", numbers.period(kind, days, F.date_add(F.to_date(F.lit("2019-12-20")), (k % 900).cast("int"))).alias("p"))
    rows = rows.withColumn("q", numbers.parsed_period(F.col("p.label")))
    return rows.select("k", "p.start", "p.end", "p.label", ((F.col("q.start") == F.col("p.start")) & (F.col("q.end") == F.col("p.end"))).alias("read_back"))


@query(f"SELECT k, ceil((k % 400 + 1) / 30.0)::BIGINT AS windows, DATE '2026-01-31' - CAST(k % 400 AS INTEGER) AS since, DATE '2026-01-31' - CAST((ceil((k % 400 + 1) / 30.0) - 1) * 30 AS INTEGER) AS last_end FROM ({_ROWS})")
def backfill_windows(t: Tables) -> DataFrame:
    """Windows of 30 days from a day backwards until the target."""
    today, target = F.to_date(F.lit("2026-01-31")), F.date_sub(F.to_date(F.lit("2026-01-31")), (F.col("k") % 400).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.floor(F.datediff(today, target) / 30).cast("int")), lambda i: F.date_sub(today, i * 30))
    return _rows(t).select("k", F.size(ends).cast("bigint").alias("windows"), target.alias("since"), F.element_at(ends, -1).alias("last_end"))


@query(f"WITH l AS ({LEDGER}), c AS (SELECT *, concat('{{\"amount\":\"', amount, '\",\"booking_date\":\"', booking_date, '\",\"currency\":\"EUR\",\"description\":\"', description, '\",\"external_id\":', CASE WHEN source = 'bank' THEN NULL ELSE 'x' END) AS x FROM l) "
       "SELECT id, sha256('{\"amount\":\"' || CAST(amount AS VARCHAR) || '\",\"booking_date\":\"' || CAST(booking_date AS VARCHAR) || '\",' || CASE WHEN source = 'bank' THEN '\"comdirect_id\":null,' ELSE '' END || '\"currency\":\"EUR\",\"description\":\"' || description || '\",' || CASE WHEN source = 'bank' THEN '' ELSE '\"external_id\":\"' || id || '\",' END || '\"recipient\":' || coalesce('\"' || recipient || '\"', 'null') || ',\"recipient_iban\":null,\"sender\":' || coalesce('\"' || sender || '\"', 'null') || ',\"sender_iban\":null,\"valuation_date\":\"' || CAST(valuation_date AS VARCHAR) || '\"}') AS content_hash FROM l")  # fmt: skip
def content_hashes(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t.ledger().select("id", "source", F.col("id").alias("external_id"), "booking_date", "valuation_date", "amount", F.lit("EUR").alias("currency"), "sender", "recipient", none.alias("sender_iban"), none.alias("recipient_iban"), "description")
    return canonical.content_hash(rows).select("id", "content_hash")


@query(f"WITH l AS ({LEDGER}) SELECT id, left(sha256(recipient || '|' || CAST(row_number() OVER (PARTITION BY recipient ORDER BY okey) - 1 AS VARCHAR)), 16) AS derived FROM l WHERE recipient IS NOT NULL")
def occurrence_ids(t: Tables) -> DataFrame:
    from pyspark.sql import window as W

    n = F.row_number().over(W.Window.partitionBy("recipient").orderBy("okey")) - 1
    rows = t.ledger().where("recipient is not null").withColumn("n", n)
    return rows.select("id", F.left(F.sha2(F.concat_ws("|", "recipient", F.col("n").cast("string")), 256), F.lit(16)).alias("derived"))


_LEGS = "SELECT k, 'EUR' AS currency, -bal AS eur FROM r WHERE k % 3 = 0"


@query(f"WITH r AS ({_ROWS}) SELECT CAST(k AS VARCHAR) AS external_id, CAST(CASE WHEN k % 3 = 0 THEN -bal ELSE bal END AS DECIMAL(18,2)) AS amount, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'USD' END AS original FROM r WHERE k % 2 = 1 OR k % 3 <> 0 UNION ALL SELECT CAST(k AS VARCHAR), CAST(bal AS DECIMAL(18,2)), 'EUR', NULL FROM r WHERE k % 6 = 0")
def wallet_conversion(t: Tables) -> DataFrame:
    """Payments of a wallet; every third has a conversion leg, which counts where the payment is foreign."""
    k, bal = F.col("k"), F.translate(F.format_number("bal", 2), ",.", ".,")
    blank = F.lit("")
    rows = _rows(t).select(k.cast("string").alias("transaction_id"), F.lit("Zahlung").alias("description_type"), "name", F.when(k % 2 == 0, "EUR").otherwise("USD").alias("currency"), bal.alias("gross"), F.lit("01.02.2026").alias("date"), blank.alias("related_transaction_id"), k.alias("line"))
    legs = _rows(t).where("k % 3 = 0").select(F.concat(F.lit("c"), k.cast("string")).alias("transaction_id"), F.lit("Allgemeine Währungsumrechnung").alias("description_type"), blank.alias("name"), F.lit("EUR").alias("currency"), F.translate(F.format_number(-F.col("bal"), 2), ",.", ".,").alias("gross"), F.lit("01.02.2026").alias("date"), k.cast("string").alias("related_transaction_id"), k.alias("line"))
    return files.wallet(rows.union(legs)).select("external_id", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", F.col("original_currency").alias("original"))


_PAGE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_name}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({_PAGE}, '\\s+', ' ', 'g')) AS text FROM pages")
def page_texts(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS unit FROM events")
def json_values(t: Tables) -> DataFrame:
    v = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.result.k"))
    n = v.try_cast("double")
    return t.raw("events").select("event_id", v.try_cast("bigint").alias("k"), F.when(n.between(0, 1), n).alias("unit"))
