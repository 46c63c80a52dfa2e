"""Mail evidence: drafts, upserts, links and what reports take from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import evidence as E
from tallyhouse.plans.registry import query
from tallyhouse.plans.reporting import END, IN_PERIOD, START
from tallyhouse.operators import ledger as L
from tallyhouse.sources.folders import stored as written
from tallyhouse.sources.tables import Tables, with_

#: A mail about each row, as expressions that both sides read.
_SUBJECT = "CASE okey % 4 WHEN 0 THEN 'Rechnung' WHEN 1 THEN 'Erstattung' WHEN 2 THEN 'Quittung' ELSE 'Your parcel' END"
_BODY = (
    "CASE WHEN okey % 8 <> 5 THEN 'Merchant: ' || CASE WHEN okey % 2 = 0 THEN 'PayPal *Zebra GmbH' ELSE coalesce(recipient, sender) END || chr(10) ELSE '' END"
    " || CASE WHEN okey % 3 <> 0 THEN 'Date: ' || CAST(booking_date AS STRING) || chr(10) ELSE '' END"
    " || CASE WHEN okey % 11 <> 0 THEN 'Total: ' || CASE WHEN okey % 2 = 0 THEN replace(CAST(abs(amount) AS STRING), '.', ',') ELSE '-' || CAST(abs(amount) AS STRING) END || ' EUR' || chr(10) ELSE '' END"
    " || CASE WHEN okey % 5 <> 0 THEN 'Order: AB-' || CAST(okey AS STRING) || chr(10) ELSE '' END"
    " || CASE okey % 7 WHEN 0 THEN 'Payment: Visa 4242' || chr(10) WHEN 1 THEN 'Payment: SEPA' || chr(10) ELSE '' END || CASE WHEN okey % 6 = 0 THEN '- Pen | 1,50 | office' ELSE '' END"
)
_MAILS = f"SELECT okey, 'm' || id AS source_message_id, booking_date + 3 AS received_at, 'shop@mail.example' AS sender, {_SUBJECT} AS subject, {_BODY} AS body_text FROM ledger"


def _x(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(txt, '(?im){pattern}', 1)), '')"


def _clean(text: str) -> str:
    """Redaction of what these mails hold: long numbers."""
    return rf"regexp_replace({text}, '\b\d{{7,}}\b', '[number]', 'g')"


_KEY = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(%s), 'paypal *', ' '), '\b(gmbh|ag|inc|ltd|co\.?|kg|se|eu|payments?)\b', ' ', 'g'), '[^a-z0-9äöüß]+', ' ', 'g'), ' +', ' ', 'g')), '')"
_DRAFTS = dict(
    mails=_MAILS, texts="SELECT *, subject || chr(10) || body_text AS txt FROM mails",
    h=rf"""SELECT *, coalesce({_x(r'^\s*(?:merchant|händler|shop|vendor)\s*:\s*(.+)$')}, {_x(r'^\s*(?:from|von)\s*:\s*(.+)$')}, 'shop') AS m, {_x(r'^\s*(?:total|betrag|summe|amount)\s*:\s*(?:EUR|€)?\s*(-?\d+[\d.,]*)')} AS a,
       TRY_CAST({_x(r'^\s*(?:date|datum|order date|bestelldatum)\s*:\s*([0-9./-]+)')} AS DATE) AS written, {_x(r'^\s*(?:order|bestellnummer|bestellung|invoice|rechnung)\s*:\s*(.+)$')} AS ref_1, {_x(r'\b(?:order|bestellnummer|bestellung|invoice|rechnung)[\s:#-]+([A-Z0-9._/-]{4,})\b')} AS ref_2,
       CASE WHEN lower(txt) LIKE '%paypal%' THEN 'paypal' WHEN lower(txt) LIKE '%visa%' THEN 'credit_card' WHEN lower(txt) LIKE '%sepa%' THEN 'direct_debit' END AS payment_method,
       CASE WHEN regexp_matches(lower(txt), '\berstattung\b') THEN 'refund' WHEN lower(txt) LIKE '%quittung%' THEN 'receipt' WHEN lower(txt) LIKE '%rechnung%' THEN 'invoice' ELSE 'order' END AS evidence_type FROM texts""",
    f="SELECT *, coalesce(ref_1, ref_2) AS ref FROM h",
    g=f"SELECT *, {_clean('m')} AS merchant_name, CAST(replace(a, ',', '.') AS DECIMAL(14,2)) AS signed, sha256(lower(trim(ref))) AS order_ref_hash FROM f",
    drafts="""SELECT *, 'mail_' || left(sha256(lower('gmail|' || coalesce(order_ref_hash, sha256(lower(source_message_id))) || '|' || evidence_type || '|' || coalesce(CAST(nullif(signed, 0) AS VARCHAR), '') || '|' || coalesce(CAST(written AS VARCHAR), ''))), 24) AS evidence_id, abs(signed) AS total_amount,
       coalesce(written, received_at) AS document_date, """ + _KEY % "merchant_name" + """ AS merchant_key,
       CAST(0.10 + 0.20 + CASE WHEN signed IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN written IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN ref IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN payment_method IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN okey % 6 = 0 THEN 0.05 ELSE 0 END AS DECIMAL(4,3)) AS confidence FROM g""",
)
_MATCHES = dict(
    hay="SELECT id, booking_date, amount, CAST(abs(amount) * 100 AS BIGINT) AS c, coalesce(" + _KEY % "concat_ws(' ', nullif(sender, ''), nullif(recipient, ''), nullif(description, ''))" + ", '') AS h FROM ledger WHERE NOT internal_transfer",
    met="""SELECT evidence_id, id, evidence_type || '_match' AS match_type, abs(date_diff('day', document_date, booking_date)) AS away, len(list_filter(string_split(merchant_key, ' '), lambda w: length(w) >= 4 AND contains(h, w))) > 0 AS named,
         coalesce(contains(h, payment_method), false) OR (payment_method = 'credit_card' AND regexp_matches(h, 'visa|mastercard|santander')) AS paid
         FROM drafts JOIN hay ON c = CAST(total_amount * 100 AS BIGINT) AND booking_date BETWEEN document_date - 7 AND document_date + 7 AND (amount > 0) = (evidence_type = 'refund')""",
    links="""SELECT evidence_id, id, match_type, CAST(550 + CASE WHEN away <= 1 THEN 150 WHEN away <= 5 THEN 80 ELSE 0 END + CASE WHEN named THEN 200 ELSE 0 END + CASE WHEN paid THEN 100 ELSE 0 END AS BIGINT) AS score,
         'amount' || CASE WHEN away <= 1 THEN '+date<=1d' WHEN away <= 5 THEN '+date<=5d' ELSE '' END || CASE WHEN named THEN '+merchant' ELSE '' END || CASE WHEN paid THEN '+payment_method' ELSE '' END AS reasons,
         'evlink_' || left(sha256(lower(id || '|' || evidence_id || '|' || match_type)), 24) AS link_id FROM met""",
)


def _messages(t: Tables) -> DataFrame:
    return t.ledger().selectExpr("'gmail' AS source", "'m' || id AS source_message_id", "date_add(booking_date, 3) AS received_at", "'shop@mail.example' AS sender", f"{_SUBJECT} AS subject", f"{_BODY} AS body_text")


def _drafts(t: Tables) -> DataFrame:
    return E.extracted(_messages(t))


def _kept_drafts(t: Tables) -> DataFrame:
    """What matching and reports read of the drafts, written once: filters and joins would have every pattern read again."""
    return written(_drafts(t).select("evidence_id", "evidence_type", "merchant_name", "merchant_key", "total_amount", "document_date", "payment_method"), "drafts")


@query(with_("ledger", **_DRAFTS) + "SELECT evidence_id, evidence_type, merchant_name, merchant_key, total_amount, document_date, payment_method, order_ref_hash, confidence FROM drafts")
def mail_drafts(t: Tables) -> DataFrame:
    return _drafts(t).select("evidence_id", "evidence_type", "merchant_name", "merchant_key", "total_amount", "document_date", "payment_method", "order_ref_hash", "confidence")


@query(with_("ledger", **_DRAFTS, **_MATCHES) + "SELECT * FROM links WHERE score >= 650")
def evidence_matches(t: Tables) -> DataFrame:
    return E.match_scores(_kept_drafts(t), t.ledger())


_STORED = "SELECT 's' || id AS evidence_id, 'gmail' AS source, CASE WHEN okey % 5 <> 0 THEN 'r' || id END AS order_ref_hash, 'invoice' AS evidence_type, CAST(amount AS DECIMAL(18,2)) AS total_amount FROM ledger WHERE okey % 6 = 0"
_COME = "SELECT CASE WHEN okey % 8 = 0 THEN 's' ELSE 'n' END || id AS evidence_id, 'gmail' AS source, CASE WHEN okey % 5 <> 0 THEN 'r' || id END AS order_ref_hash, 'invoice' AS evidence_type, CAST(amount * 2 AS DECIMAL(18,2)) AS total_amount FROM ledger WHERE okey % 4 = 0"


@query(with_("ledger", s=_STORED, i=_COME, k="SELECT i.*, coalesce(a.evidence_id, b.evidence_id, i.evidence_id) AS target FROM i LEFT JOIN s a ON a.evidence_id = i.evidence_id LEFT JOIN s b ON b.order_ref_hash = i.order_ref_hash")
       + "SELECT coalesce(target, s.evidence_id) AS evidence_id, coalesce(k.order_ref_hash, s.order_ref_hash) AS order_ref_hash, coalesce(k.total_amount, s.total_amount) AS total_amount FROM s FULL JOIN k ON k.target = s.evidence_id")
def evidence_upsert(t: Tables) -> DataFrame:
    rows = t.ledger()
    made = lambda own, factor: rows.select(F.concat(own, "id").alias("evidence_id"), F.lit("gmail").alias("source"), F.when(F.col("okey") % 5 != 0, F.concat(F.lit("r"), "id")).alias("order_ref_hash"), F.lit("invoice").alias("evidence_type"), (F.col("amount") * factor).cast("decimal(18,2)").alias("total_amount"), "okey")
    stored = made(F.lit("s"), 1).where("okey % 6 = 0").drop("okey")
    drafts = made(F.when(F.col("okey") % 8 == 0, "s").otherwise("n"), 2).where("okey % 4 = 0")
    return E.upsert_evidence(stored, drafts, "okey").select("evidence_id", "order_ref_hash", "total_amount")


@query(with_("ledger", **_DRAFTS, **_MATCHES, n="SELECT * FROM links WHERE score >= 650") + "SELECT link_id, id, score, CASE WHEN ascii(right(id, 1)) % 2 = 0 THEN 'again' ELSE 'new' END AS state FROM n UNION ALL SELECT 'old' || id, id, 1 AS score, 'old' FROM ledger WHERE okey % 400 = 0")
def evidence_links(t: Tables) -> DataFrame:
    """Links that are stored already with another score take the new one."""
    found = written(E.match_scores(_kept_drafts(t), t.ledger()), "links").withColumn("state", F.lit("new"))  # read twice
    again = found.where("ascii(right(id, 1)) % 2 = 0")
    old = t.ledger().where("okey % 400 = 0").select(F.lit("e").alias("evidence_id"), "id", F.lit("x_match").alias("match_type"), F.lit(1).cast("bigint").alias("score"), F.lit("").alias("reasons"), F.concat(F.lit("old"), "id").alias("link_id"), F.lit("old").alias("state"))
    stored = again.withColumns({"score": F.lit(0).cast("bigint"), "state": F.lit("again")}).unionByName(old)
    now = E.upsert_links(stored, found.withColumn("state", F.when(F.expr("ascii(right(id, 1)) % 2 = 0"), "again").otherwise("new")))
    return now.select("link_id", "id", "score", "state")


@query(with_("ledger", "categories", **_DRAFTS, **_MATCHES, n="SELECT * FROM links WHERE score >= 650") + f"SELECT t.id, t.booking_date, CAST(t.amount AS DECIMAL(18,2)) AS amount, name, n.evidence_id, d.evidence_type, d.merchant_name, n.score AS evidence_score FROM ledger t LEFT JOIN categories USING (category_id) LEFT JOIN n ON n.id = t.id LEFT JOIN drafts d ON d.evidence_id = n.evidence_id WHERE t.amount < 0 AND NOT internal_transfer AND {IN_PERIOD} ORDER BY t.amount, t.id, n.evidence_id NULLS FIRST LIMIT 20")
def debits_with_evidence(t: Tables) -> DataFrame:
    drafts, rows = _kept_drafts(t), t.ledger()
    return E.top_debits(L.between(rows, START, END), t.categories(), E.match_scores(drafts, rows), drafts).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@query(with_("ledger", **_DRAFTS) + "SELECT evidence_id, evidence_type, document_date, total_amount FROM drafts ORDER BY document_date DESC NULLS LAST, evidence_id LIMIT 50")
def evidence_list(t: Tables) -> DataFrame:
    return E.newest(_drafts(t), n=50).select("evidence_id", "evidence_type", "document_date", "total_amount")


@query(with_("ledger", **_DRAFTS) + f"SELECT evidence_id, merchant_name, document_date, confidence FROM drafts WHERE document_date BETWEEN DATE '{START}' AND DATE '{END}' ORDER BY document_date DESC, evidence_id LIMIT 100")
def evidence_of_period(t: Tables) -> DataFrame:
    return E.newest(_drafts(t), START, END).select("evidence_id", "merchant_name", "document_date", "confidence")


_KEPT = _DRAFTS | {"all_": _DRAFTS["drafts"], "drafts": "SELECT * FROM all_ WHERE total_amount IS NOT NULL AND confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY coalesce(order_ref_hash || evidence_type, evidence_id) ORDER BY source_message_id DESC) = 1"}
_KEPT = {k: _KEPT[k] for k in ("mails", "texts", "h", "f", "g", "all_", "drafts")}


@query(with_("ledger", **_KEPT, **_MATCHES) + "SELECT (SELECT count(*) FROM drafts) AS evidence, (SELECT count(*) FROM links WHERE score >= 650) AS links, (SELECT CAST(sum(score) AS BIGINT) FROM links WHERE score >= 650) AS score")
def mail_import(t: Tables) -> DataFrame:
    """A batch of messages, extracted, put in and matched: how much there is of each afterwards."""
    rows, drafts = t.ledger(), _drafts(t)
    evidence, links = E.imported(_messages(t), drafts.where("false"), E.match_scores(drafts.where("false"), rows), rows)
    return evidence.agg(F.countDistinct("evidence_id").alias("evidence")).join(links.agg(F.count("*").alias("links"), F.sum("score").alias("score")), F.lit(True))
