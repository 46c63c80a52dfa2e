"""Enrichment, pairing, versions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money
from tallyhouse.operators import enrich, normalise, runs, versions
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_

#: Patterns, categories and priorities; the one that does not compile is ignored.
RULES = [("building", "housing", 10), ("auto(mobile)?", "car", 30), ("urgent mach", "repairs", 50), ("([", "broken", 90), ("^ +customer#0000000[0-4]", "friends", 20), ("household|furniture", "home", 5)]
_HAY = "lower(coalesce(sender, '') || ' ' || coalesce(recipient, '') || ' ' || coalesce(description, ''))"
_RULE = "CASE WHEN regexp_matches(hay, 'urgent mach') THEN 'repairs' WHEN regexp_matches(hay, 'auto(mobile)?') THEN 'car' WHEN regexp_matches(hay, '^ +customer#0000000[0-4]') THEN 'friends' WHEN regexp_matches(hay, 'building') THEN 'housing' WHEN regexp_matches(hay, 'household|furniture') THEN 'home' END"
_MATCHED = f"SELECT id, category_id, {_RULE} AS matched FROM (SELECT *, {_HAY} AS hay FROM ledger)"


@query(with_("ledger", mt=_MATCHED) + "SELECT id, matched, coalesce(category_id, matched) AS category_id FROM mt")
def rule_match(t: Tables) -> DataFrame:
    return enrich.apply_rules(t.ledger(), RULES).select("id", "matched", "category_id")


@query(with_("ledger", mt=_MATCHED) + "SELECT count(*) AS processed, count(matched) AS matched, count(*) - count(matched) AS unchanged FROM mt WHERE category_id IS NULL")
def rule_counts(t: Tables) -> DataFrame:
    rows = t.ledger().where("category_id is null").select(enrich.rule_category(RULES).alias("matched"))
    return rows.agg(F.count("*").alias("processed"), F.count("matched").alias("matched"), (F.count("*") - F.count("matched")).alias("unchanged"))


def _regular(t: Tables) -> DataFrame:
    """The ledger with amounts that vary little for even customers and much for odd ones."""
    k = F.when(F.col("custkey") % 2 == 0, F.lit(1)).otherwise(F.lit(20))
    value = (1000 + F.col("custkey")) * (100 + (F.col("okey") % 7 - 3) * k)
    return t.ledger().select("id", "booking_date", F.col("custkey").cast("string").alias("recipient"), F.lit(None).cast("string").alias("sender"), (-value / 100).cast("decimal(14,2)").alias("amount"))


_RUNS = dict(
    x="SELECT CAST(custkey AS VARCHAR) AS counterpart, id, year(booking_date) * 12 + month(booking_date) AS m, CAST((1000 + custkey) * (100 + (okey % 7 - 3) * CASE WHEN custkey % 2 = 0 THEN 1 ELSE 20 END) AS DOUBLE) AS c FROM ledger",
    mo="SELECT counterpart, m, m - row_number() OVER (PARTITION BY counterpart ORDER BY m) AS island FROM (SELECT DISTINCT counterpart, m FROM x)",
    w="SELECT x.*, island FROM x JOIN mo USING (counterpart, m)",
    patterns="SELECT counterpart, min(m) AS first, max(m) AS last, count(DISTINCT m) AS months, count(*) AS n, round(avg(c) / 100, 2) AS avg_amount FROM w GROUP BY counterpart, island HAVING count(DISTINCT m) >= 3 AND count(*) * sum(c * c) - sum(c) * sum(c) <= 0.01 * sum(c) * sum(c)",
)


@query(with_("ledger", **_RUNS) + "SELECT counterpart, first, last, months, n, avg_amount FROM patterns")
def recurring_patterns(t: Tables) -> DataFrame:
    return enrich.recurring(_regular(t))[0]


@query(with_("ledger", **_RUNS) + "SELECT id, x.counterpart, first AS pattern_start FROM x JOIN patterns p ON x.counterpart = p.counterpart AND m BETWEEN first AND last")
def recurring_flags(t: Tables) -> DataFrame:
    return enrich.recurring(_regular(t))[1]


@query("""WITH a AS (SELECT event_id, event_type, value, median(value) OVER (PARTITION BY event_type) AS med, count(*) OVER (PARTITION BY event_type) AS size FROM events),
b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY event_type) AS mad, avg(abs(value - med)) OVER (PARTITION BY event_type) AS mean_away FROM a),
z AS (SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (value - med) / mad WHEN mean_away > 0 THEN (value - med) / (1.253314 * mean_away) ELSE 0.0 END AS z FROM b)
SELECT event_id, event_type, round(z, 4) AS z FROM z WHERE size >= 3 AND abs(z) > 3.5""")  # fmt: skip
def robust_outliers(t: Tables) -> DataFrame:
    return enrich.outliers(t.raw("events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "event_type", F.round("z", 4).alias("z"))


@query(with_("ledger") + "SELECT id, CASE WHEN segment = 'BUILDING' THEN 'apotheke' WHEN segment = 'AUTOMOBILE' THEN 'paypal friends' WHEN segment = 'MACHINERY' THEN 'bonus' WHEN segment = 'FURNITURE' THEN 'finanzamt' END AS refund_word, CASE WHEN segment = 'BUILDING' THEN 'gesundheit' WHEN segment = 'AUTOMOBILE' THEN 'restaurant-cafe' END AS suggested_category, CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN true WHEN segment IN ('AUTOMOBILE', 'MACHINERY') THEN false END AS auto FROM (SELECT id, substr(description, strpos(description, ' ') + 1) AS rest, CASE WHEN description LIKE '%BUILDING' THEN 'BUILDING' WHEN description LIKE '%AUTOMOBILE' THEN 'AUTOMOBILE' WHEN description LIKE '%MACHINERY' THEN 'MACHINERY' WHEN description LIKE '%FURNITURE' THEN 'FURNITURE' END AS segment, amount FROM ledger) WHERE amount > 0")
def refund_suggestions(t: Tables) -> DataFrame:
    return enrich.refund_suggestion(_refund_texts(t).where("amount > 0")).select("id", "refund_word", "suggested_category", "auto")


def _refund_texts(t: Tables) -> DataFrame:
    d = F.col("description")
    text = F.when(d.endswith("BUILDING"), "Stadt-Apotheke 12").when(d.endswith("AUTOMOBILE"), "Friends of PAYPAL").when(d.endswith("MACHINERY"), "Hausrat-Bonus").when(d.endswith("FURNITURE"), "Finanzamt Mitte").otherwise("nothing")
    return t.ledger().withColumns({"description": text, "sender": F.lit(None).cast("string")})


@query(with_("ledger") + "SELECT CAST(count_if(amount > 0 AND description LIKE '%BUILDING') AS BIGINT) AS applied_refund, CAST(count_if(amount > 0 AND description LIKE '%FURNITURE') AS BIGINT) AS applied_income, CAST(count_if(amount > 0 AND description NOT LIKE '%BUILDING' AND description NOT LIKE '%FURNITURE') AS BIGINT) AS left_for_review FROM ledger")
def refund_outcomes(t: Tables) -> DataFrame:
    s = enrich.refund_suggestion(_refund_texts(t).where("amount > 0"))
    auto = F.coalesce("auto", F.lit(False))
    return s.agg(F.count_if(auto & F.col("suggested_category").isNotNull()).alias("applied_refund"), F.count_if(auto & F.col("suggested_category").isNull()).alias("applied_income"), F.count_if(~auto).alias("left_for_review"))


@query(with_("ledger") + "SELECT id, CAST(amount AS DECIMAL(18,2)) AS amount FROM ledger WHERE category_id = '5-LOW' AND NOT is_refund AND amount > 0 AND NOT internal_transfer")
def refund_candidates(t: Tables) -> DataFrame:
    rows = t.ledger().withColumn("refund_audit_decided_at", F.lit(None).cast("timestamp"))
    return enrich.refund_candidates(rows, "5-LOW").select("id", money(F.col("amount")).alias("amount"))


_KEYS = "CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN right(c_name, 4) WHEN 2 THEN 'pay to ' || c_name || ' now' ELSE right(c_name, 3) END"


@query(with_("ledger", h="SELECT *, lower(coalesce(nullif(recipient, ''), nullif(sender, ''))) AS counterpart FROM ledger WHERE category_id IS NOT NULL", ks=f"SELECT DISTINCT lower({_KEYS}) AS k FROM customer WHERE c_acctbal < 0", n="SELECT DISTINCT counterpart FROM h", known="SELECT counterpart FROM n WHERE EXISTS (SELECT 1 FROM ks WHERE length(k) >= 4 AND (contains(counterpart, k) OR (length(counterpart) >= 4 AND contains(k, counterpart))))",
             top="SELECT *, row_number() OVER (PARTITION BY counterpart, category_id ORDER BY booking_date DESC, id) AS r FROM h WHERE counterpart IN (SELECT counterpart FROM known)")
       + "SELECT id, counterpart, category_id, booking_date FROM top WHERE r = 1 ORDER BY booking_date DESC, id LIMIT 1000")
def memory_examples(t: Tables) -> DataFrame:
    """Keys are names, ends of names and texts around names of all customers in debt."""
    keys = t.raw("customer").where("c_acctbal < 0").selectExpr(f"{_KEYS} AS key")
    return enrich.memory_examples(t.ledger(), keys, most=1000)


def _arrivals(t: Tables) -> DataFrame:
    return t.ledger().select("source", F.col("custkey").cast("string").alias("external_id"), F.sha2(F.concat_ws("|", "custkey", "amount"), 256).alias("content_hash"), F.col("okey").alias("arrival"))


_VERSIONS = dict(
    f="SELECT source, CAST(custkey AS VARCHAR) AS external_id, sha256(CAST(custkey AS VARCHAR) || '|' || CAST(amount AS VARCHAR)) AS content_hash, okey AS arrival FROM ledger QUALIFY row_number() OVER (PARTITION BY sha256(CAST(custkey AS VARCHAR) || '|' || CAST(amount AS VARCHAR)) ORDER BY okey) = 1",
    v="SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY arrival) AS version, lead(content_hash) OVER (PARTITION BY source, external_id ORDER BY arrival) AS superseded_by FROM f",
)


@query(with_("ledger", **_VERSIONS) + "SELECT * FROM v")
def raw_versions(t: Tables) -> DataFrame:
    return versions.versions(_arrivals(t))


@query(with_("ledger", **_VERSIONS) + "SELECT * FROM v WHERE superseded_by IS NULL")
def active_versions(t: Tables) -> DataFrame:
    return versions.active(versions.versions(_arrivals(t)))


@query(with_("ledger", **_VERSIONS) + "SELECT * FROM v")
def incremental_versions(t: Tables) -> DataFrame:
    """The same in two batches, the second of which repeats part of the first."""
    rows = _arrivals(t)
    return versions.insert_versions(versions.versions(rows.where("arrival < 8000")), rows.where("arrival >= 4000"))


@query(with_("ledger") + "SELECT id, CASE WHEN okey % 2 = 0 AND okey % 3 = 0 THEN amount * 2 ELSE amount END::DECIMAL(18,2) AS amount, CASE WHEN okey % 2 = 0 THEN coalesce(category_id, CASE WHEN okey % 3 = 0 THEN 'new' END) ELSE 'new' END AS category_id, booking_date FROM ledger WHERE okey % 2 = 0 OR okey % 3 = 0")
def normalised_upsert(t: Tables) -> DataFrame:
    rows = t.ledger().select("id", "okey", money(F.col("amount")).alias("amount"), "category_id", "booking_date")
    stored = rows.where("okey % 2 = 0").drop("okey")
    changed = F.when(F.col("okey") % 2 == 0, money(F.col("amount") * 2)).otherwise(F.col("amount"))
    incoming = rows.where("okey % 3 = 0").select("id", changed.alias("amount"), F.lit("new").alias("category_id"), F.when(F.col("okey") % 2 == 0, F.to_date(F.lit("1970-01-01"))).otherwise(F.col("booking_date")).alias("booking_date"))
    return versions.upsert(stored, incoming, ["id"], fixed=["booking_date"], keep_set=["category_id"])


@query(with_("ledger") + "SELECT id, 'manual' AS kind FROM ledger WHERE okey % 3 = 0 UNION ALL SELECT DISTINCT id, 'auto' AS kind FROM ledger WHERE okey % 5 = 0")
def replaced_links(t: Tables) -> DataFrame:
    rows = t.ledger().select("id", "okey")
    stored = rows.where("okey % 3 <> 2").select("id", F.when(F.col("okey") % 3 == 0, "manual").otherwise("auto").alias("kind"))
    new = rows.where("okey % 5 = 0").select("id", F.lit("auto").alias("kind"))
    return versions.replace_where(stored, new.union(new), "kind", ["auto"], ["id", "kind"])


def _runs(t: Tables) -> DataFrame:
    """A run a customer: suggestions for its orders as JSON, every seventh confidence out of range."""
    s = F.struct(F.col("id").alias("transaction_id"), F.lit("5-LOW").alias("suggested_category_id"), F.when(F.col("okey") % 7 == 0, F.lit("7.5")).otherwise((F.col("okey") % 10 / 10).cast("string")).alias("confidence"), F.lit("x").alias("reasoning"))
    rows = t.ledger().groupBy(F.col("custkey").alias("run_id")).agg(F.array_sort(F.collect_list(s)).alias("s"))
    deep = F.to_json(F.struct(F.struct(F.col("s").alias("suggestions")).alias("categorization")))
    return rows.select("run_id", F.when(F.col("run_id") % 2 == 0, deep).otherwise(F.to_json(F.struct(F.col("s").alias("suggestions")))).alias("result"))


_CONF = "CASE WHEN okey % 7 <> 0 THEN (okey % 10) / 10.0 END"


@query(with_("ledger", s=f"SELECT custkey, {_CONF} AS c FROM ledger") + "SELECT (SELECT count(DISTINCT custkey) FROM ledger) AS runs, count(*) AS suggestions, CAST(count_if(c >= 0.6) AS BIGINT) AS high, round(avg(c), 4) AS avg_confidence, round(count_if(c >= 0.6) / count(*), 4) AS auto_apply_rate FROM s")
def run_health(t: Tables) -> DataFrame:
    return runs.health(_runs(t))


@query(with_("ledger") + f"SELECT id AS transaction_id, '5-LOW' AS suggested_category_id, CAST({_CONF} AS DOUBLE) AS confidence, CAST(amount AS DECIMAL(18,2)) AS amount, 'low' AS name FROM ledger WHERE category_id IS NULL AND okey % 3 <> 0")
def pending_suggestions(t: Tables) -> DataFrame:
    rejected = t.ledger().where("okey % 3 = 0").select(F.col("id").alias("transaction_id"), F.lit("5-LOW").alias("suggested_category_id"))
    categories = t.categories().withColumn("name", F.trim("name"))
    found = runs.pending(runs.suggestions(_runs(t)), t.ledger(), rejected, categories)
    return found.select("transaction_id", "suggested_category_id", "confidence", money(F.col("amount")).alias("amount"), "name")


@query(with_("ledger") + f"SELECT id, coalesce(category_id, CASE WHEN {_CONF} >= 0.6 THEN '5-LOW' END) AS category_id FROM ledger")
def applied_suggestions(t: Tables) -> DataFrame:
    return runs.apply_suggestions(t.ledger(), runs.best_suggestion(runs.suggestions(_runs(t)))).select("id", "category_id")


@query("SELECT user_id % 7 AS kind, event_id AS run_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) = 1")
def last_run_per_source(t: Tables) -> DataFrame:
    rows = t.raw("events").select((F.col("user_id") % 7).alias("kind"), F.col("event_id").alias("run_id"), "ts", "event_type", "value")
    return runs.last_by(rows, "kind", "ts").select("kind", "run_id", "event_type", "value")


@query("SELECT event_id AS run_id FROM events WHERE event_type <> 'purchase' AND CASE WHEN event_id % 4 <> 0 THEN epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) > 300 ELSE epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) > 600 END")
def stale_runs(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = t.raw("events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "purchase", "running").otherwise("done").alias("status"), F.when(F.col("event_id") % 4 != 0, ts).alias("heartbeat_at"), ts.alias("started_at"))
    return runs.stale(rows, "2024-01-20 00:00:00").select("run_id")


PRICES = [("click", 1.0, 2.0), ("view", 0.5, 1.5), ("purchase", 3.0, 4.0)]


@query("SELECT event_type AS model, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens, round(coalesce((sum(event_id) * a + sum(user_id) * b) / 1e6, 0), 6) AS cost FROM events LEFT JOIN (VALUES ('click', 1.0::DOUBLE, 2.0::DOUBLE), ('view', 0.5, 1.5), ('purchase', 3.0, 4.0)) p(m, a, b) ON m = event_type GROUP BY event_type, a, b")
def token_cost(t: Tables) -> DataFrame:
    usage = t.raw("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return runs.token_cost(usage, t.spark.createDataFrame(PRICES, "model string, input_price double, output_price double"))


_FIELDS = ("id", "sender", "recipient", "category_id", "source", "description")


@query(with_("ledger") + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(nullif({c}, '')) AS filled, count(DISTINCT nullif({c}, '')) AS n_values, round(count(nullif({c}, '')) / count(*), 4) AS fill_rate, count(DISTINCT nullif({c}, '')) = count(nullif({c}, '')) AS is_unique FROM ledger" for c in _FIELDS))
def field_profile(t: Tables) -> DataFrame:
    return runs.field_profile(t.ledger(), list(_FIELDS))


@query(with_("ledger", x="SELECT id, CASE WHEN description LIKE '%BUILDING' THEN 'gesundheit' ELSE category_id END AS c, category_id, is_refund, description, category_id = '5-LOW' AND NOT is_refund AND amount > 0 AND NOT internal_transfer AND (description LIKE '%BUILDING' OR description LIKE '%FURNITURE') AS hit FROM ledger")
       + "SELECT id, CASE WHEN hit THEN c ELSE category_id END AS category_id, is_refund OR coalesce(hit AND description LIKE '%BUILDING', false) AS is_refund, coalesce(hit, false) AS decided FROM x")
def refunds_decided(t: Tables) -> DataFrame:
    """The ledger after the clear refunds and incomes were decided."""
    rows = _refund_texts(t).withColumn("refund_audit_decided_at", F.lit(None).cast("timestamp"))
    return enrich.decided(rows, "5-LOW", "2024-01-01").select("id", "category_id", "is_refund", F.col("refund_audit_decided_at").isNotNull().alias("decided"))


def _payloads(t: Tables) -> DataFrame:
    """The ledger as the bank's bookings come: JSON with the counterparty under creditor or remitter."""
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("holderName")))
    value = F.struct(F.col("amount").cast("string").alias("value"), F.lit("EUR").alias("unit"))
    raw = F.to_json(F.struct(F.col("id").alias("transactionId"), F.col("booking_date").cast("string").alias("bookingDate"), value.alias("transactionValue"), side("recipient").alias("creditor"), side("sender").alias("remitter"), F.col("description").alias("remittanceInfo")))
    return t.ledger().select(F.lit("bank").alias("source"), raw.alias("raw"), F.col("okey").alias("arrival"))


_PASS = dict(
    b=f"SELECT id, booking_date, coalesce(recipient, sender) AS counterpart, {_RULE} AS category_id, abs(CAST(amount * 100 AS BIGINT))::DOUBLE AS c, abs(amount)::DOUBLE AS v, year(booking_date) * 12 + month(booking_date) AS m FROM (SELECT *, {_HAY} AS hay FROM ledger)",
    mo="SELECT counterpart, m, m - row_number() OVER (PARTITION BY counterpart ORDER BY m) AS island FROM (SELECT DISTINCT counterpart, m FROM b)",
    w="SELECT b.*, island FROM b JOIN mo USING (counterpart, m)",
    pt="SELECT counterpart, min(m) AS first, max(m) AS last FROM w GROUP BY counterpart, island HAVING count(DISTINCT m) >= 3 AND count(*) * sum(c * c) - sum(c) * sum(c) <= 0.01 * sum(c) * sum(c)",
    o1="SELECT id, category_id, v, median(v) OVER (PARTITION BY category_id) AS med, count(*) OVER (PARTITION BY category_id) AS size FROM b",
    o2="SELECT *, median(abs(v - med)) OVER (PARTITION BY category_id) AS mad, avg(abs(v - med)) OVER (PARTITION BY category_id) AS mean_away FROM o1",
    o3="SELECT id, size >= 3 AND abs(CASE WHEN mad > 0 THEN 0.6745 * (v - med) / mad WHEN mean_away > 0 THEN (v - med) / (1.253314 * mean_away) ELSE 0.0 END) > 3.5 AS is_outlier FROM o2",
)


@query(with_("ledger", **_PASS) + "SELECT id, category_id, EXISTS (SELECT 1 FROM pt WHERE pt.counterpart = b.counterpart AND b.m BETWEEN first AND last) AS is_recurring, is_outlier, false AS internal_transfer FROM b JOIN o3 USING (id)")
def normalised_ledger(t: Tables) -> DataFrame:
    """All of the bank's bookings, ingested into an empty store and taken through the whole pass."""
    nothing = t.spark.createDataFrame([], "source string, external_id string, content_hash string, arrival long, raw string, version long, superseded_by string").limit(0)  # which the optimiser knows to be empty
    _, found = normalise.ingested(nothing, _payloads(t), RULES, ["DE0"])
    return found.ledger.select(F.col("external_id").alias("id"), "category_id", "is_recurring", "is_outlier", "internal_transfer")


@query(with_("ledger") + "SELECT id, CASE WHEN okey % 4 = 0 THEN 'changed' ELSE 'same' END AS state FROM ledger WHERE okey % 2 = 0")
def changed_hashes(t: Tables) -> DataFrame:
    """Which stored rows a reading of their payload would give another hash; odd rows have no payload."""
    from tallyhouse.sources import canonical

    rows = _payloads(t).withColumn("payload", F.col("raw"))
    kept = canonical.content_hash(canonical.bank(rows, "payload", "arrival"))
    stored = kept.select("source", F.when(F.col("arrival") % 2 == 0, F.concat(F.lit('{"source_payload": '), "payload", F.lit("}"))).otherwise(F.col("payload")).alias("raw"), F.when(F.col("arrival") % 4 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(None).cast("string").alias("superseded_by"), F.col("external_id").alias("id"), (F.col("arrival") % 2 == 0).alias("even"))
    found = normalise.hash_changes(stored).select(F.col("old").alias("content_hash"), F.lit("changed").alias("state"))
    return stored.where("even").join(found, "content_hash", "left").select("id", F.coalesce("state", F.lit("same")).alias("state"))
