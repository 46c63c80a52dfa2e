"""Patches, deletions and the books of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money
from tallyhouse.operators import changes as C
from tallyhouse.operators import enrich
from tallyhouse.plans.analysis import _regular, _RUNS
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_


@query(with_("ledger") + """SELECT id, CASE WHEN okey % 6 = 0 THEN NULL WHEN okey % 6 = 2 THEN 'new' ELSE category_id END AS category_id, CASE WHEN okey % 2 = 0 AND okey % 5 = 0 THEN true WHEN okey % 2 = 0 AND okey % 5 = 1 THEN false ELSE is_refund END AS is_refund,
       CASE WHEN okey % 2 = 0 AND okey % 7 = 0 THEN true WHEN okey % 2 = 0 AND okey % 7 = 1 THEN false WHEN okey % 2 = 0 AND okey % 5 = 0 THEN true ELSE okey % 3 = 0 END AS decided FROM ledger""")
def patched_transactions(t: Tables) -> DataFrame:
    key, day = F.col("okey"), F.to_timestamp(F.lit("2024-01-01"))
    rows = t.ledger().withColumn("refund_audit_decided_at", F.when(key % 3 == 0, day))
    patches = t.ledger().where("okey % 2 = 0").select(
        "id", (key % 6 != 4).alias("set_category"), F.when(key % 6 == 2, "new").alias("category_id"), F.when(key % 5 == 0, True).when(key % 5 == 1, False).alias("is_refund"),
        F.lit(None).cast("boolean").alias("internal_transfer"), F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("decided"), day.alias("at"))
    return C.patched(rows, patches).select("id", "category_id", "is_refund", F.col("refund_audit_decided_at").isNotNull().alias("decided"))


@query(with_("ledger", "tags") + "SELECT id, tag FROM tags WHERE CAST(id AS BIGINT) % 4 <> 0 UNION ALL SELECT id, 'nine' FROM ledger WHERE okey % 8 = 0")
def replaced_tags(t: Tables) -> DataFrame:
    """Each fourth row is given a list: one tag twice, or none."""
    patches = t.ledger().where("okey % 4 = 0").select("id", F.when(F.col("okey") % 8 == 0, F.array(F.lit("nine"), F.lit("nine"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    same = t.ledger().where("okey % 4 = 1").select("id", F.lit(None).cast("array<string>").alias("tags"))
    return C.retagged(t.tags(), patches.union(same))


@query(with_("ledger", "budgets") + "SELECT id, nullif(category_id, '2-HIGH') AS category_id FROM ledger UNION ALL SELECT 'budget', category_id FROM budgets WHERE category_id <> '2-HIGH'")
def category_deleted(t: Tables) -> DataFrame:
    ledger, budgets = C.without_category(t.ledger(), t.budgets(), "2-HIGH")
    return ledger.select("id", "category_id").union(budgets.select(F.lit("budget"), "category_id"))


@query(with_("tags") + "SELECT id, tag FROM tags WHERE tag <> 'five'")
def tag_deleted(t: Tables) -> DataFrame:
    return C.without_tag(t.tags(), "five")


_REPORTS = "SELECT event_type AS report_type, CAST(ts AS DATE) AS period_start, CAST(ts AS DATE) AS period_end, max(event_id) AS content FROM events GROUP BY 1, 2"


@query(f"WITH r AS ({_REPORTS}) SELECT report_type, period_start, period_end, CASE WHEN report_type = 'click' THEN -content ELSE content END AS content FROM r")
def reports_saved(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    old = t.raw("events").groupBy(F.col("event_type").alias("report_type"), day.alias("period_start")).agg(F.max("event_id").alias("content")).select("report_type", "period_start", F.col("period_start").alias("period_end"), "content")
    return C.report_saved(old, old.where("report_type = 'click'").withColumn("content", -F.col("content")))


@query("""WITH e AS (SELECT user_id AS run_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN 'started' WHEN 1 THEN 'finished' ELSE 'beat' END AS kind, CASE WHEN event_id % 8 = 1 THEN 'broken' END AS error FROM events),
f AS (SELECT run_id, max(ts) AS done FROM e WHERE kind = 'finished' GROUP BY 1), l AS (SELECT run_id, max(ts) AS beat FROM e WHERE kind = 'beat' GROUP BY 1), s AS (SELECT run_id, min(ts) AS began FROM e WHERE kind = 'started' GROUP BY 1),
x AS (SELECT f.run_id, max(error) AS error FROM f JOIN e ON e.run_id = f.run_id AND e.ts = f.done AND kind = 'finished' GROUP BY 1)
SELECT run_id, CASE WHEN done IS NULL THEN 'running' WHEN error IS NOT NULL THEN 'failed' ELSE 'completed' END AS status, CAST(epoch_ms(began) AS BIGINT) // 1000 AS began, CASE WHEN done IS NULL OR beat <= done THEN CAST(epoch_ms(beat) AS BIGINT) // 1000 END AS beat FROM (SELECT DISTINCT run_id FROM e) LEFT JOIN f USING (run_id) LEFT JOIN l USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN x USING (run_id)""")
def run_book(t: Tables) -> DataFrame:
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    events = t.raw("events").select(F.col("user_id").alias("run_id"), F.when(kind == 0, "started").when(kind == 1, "finished").otherwise("beat").alias("kind"), ts.alias("at"), F.lit("bank").alias("source"), F.lit(1).alias("rows"), F.when(F.col("event_id") % 8 == 1, "broken").alias("error"))
    nothing = t.spark.createDataFrame([], "run_id long, source string, status string, started_at timestamp, finished_at timestamp, heartbeat_at timestamp, rows int, error string")
    second = lambda c: F.expr(f"CAST(round(unix_micros({c}) / 1000) AS BIGINT) div 1000")  # noqa: E731 - of the time to the nearest millisecond, as the SQL has it
    return C.run_events(nothing, events).select("run_id", "status", second("started_at").alias("began"), second("heartbeat_at").alias("beat"))


@query(with_("ledger", **_RUNS) + "SELECT counterpart, count(*) AS n FROM x JOIN patterns p USING (counterpart) WHERE m BETWEEN first AND last GROUP BY counterpart, first")
def recurring_ids(t: Tables) -> DataFrame:
    """How many rows point to each stored pattern."""
    patterns, flags = enrich.recurring(_regular(t))
    stored, pointers = C.recurring_stored(t.spark.createDataFrame([], "pattern_id long, counterpart string, first long, last long, months long, n long, avg_amount double"), patterns, flags)
    return pointers.groupBy("pattern_id").agg(F.count("*").alias("n")).join(stored.select("pattern_id", "counterpart"), "pattern_id").select("counterpart", "n")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS depot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Depot ' || n_name ELSE n_name END AS depot_type, 'EUR' AS currency FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT '900', 'kept', 'USD'")
def depots_saved(t: Tables) -> DataFrame:
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    nested = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 != 0, key).alias("depotId"), F.struct(F.concat(F.lit("Depot "), name).alias("text")).alias("depotType")))
    plain = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 != 0, key).alias("depotId"), name.alias("depotType")))
    first = t.raw("nation").select(F.lit(1).alias("seq"), F.to_json(F.struct(key.alias("depotId"), F.lit("old").alias("depotType"))).alias("raw")).where(F.col("n_nationkey") % 5 != 0)
    last = t.raw("nation").select(F.lit(2).alias("seq"), F.when(F.col("n_nationkey") % 2 == 0, nested).otherwise(plain).alias("raw"))
    stored = t.spark.createDataFrame([("900", None, "kept", "USD")], "depot_id string, client_id string, depot_type string, currency string")
    return C.depots_saved(stored, first.union(last)).select("depot_id", "depot_type", "currency")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'too many requests' WHEN 1 THEN 'no connection' WHEN 2 THEN 'limit reached' WHEN 3 THEN 'malformed answers' ELSE 'odd' END AS message, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS agents, count(*) AS n FROM events GROUP BY 1")
def errors_grouped(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429", "Connection error.", "you have reached your specified API usage limits", "Exceeded maximum retries (3)", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    return C.errors_grouped(t.raw("events").select(F.col("event_type").alias("agent"), raw.alias("message")))


@query("SELECT event_id, 'k' AS key, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 3 < 2")
def metric_lists(t: Tables) -> DataFrame:
    v = F.col("event_id").cast("string")
    json = F.when(F.col("event_id") % 3 == 0, F.to_json(F.create_map(F.lit("k"), v))).when(F.col("event_id") % 3 == 1, F.to_json(F.array(F.struct(F.lit("k").alias("key"), v.alias("value"))))).otherwise("[]")
    return t.raw("events").select("event_id", F.explode(C.metric_list(json)).alias("m")).select("event_id", "m.key", "m.value")
