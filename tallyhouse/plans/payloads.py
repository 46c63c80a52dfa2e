"""JSON of any shape: what a prompt may show, which keys there are; and a source that is read back in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import SANITISERS
from tallyhouse.operators import backfill, payloads, prompts
from tallyhouse.plans.pairs import recursive
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_

_PSEUDONYM = "CASE WHEN {n} < 100 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


@query(with_("ledger", n="SELECT custkey, row_number() OVER (ORDER BY min(okey), custkey) AS n FROM ledger GROUP BY 1") + f"SELECT okey, 'tx_' || {_PSEUDONYM.format(n='rn')} AS transaction_id, 'ev_' || {_PSEUDONYM.format(n='n')} AS evidence_id FROM (SELECT *, row_number() OVER (ORDER BY okey) AS rn FROM ledger) JOIN n USING (custkey)")
def prompt_pseudonyms(t: Tables) -> DataFrame:
    """Ids of all rows as a prompt shows them; a banned column is gone."""
    rows = t.ledger().select(F.col("id").alias("transaction_id"), "okey", F.col("custkey").cast("string").alias("evidence_id"), F.col("description").alias("order_reference"))
    return prompts.for_prompt(rows, "okey").select("okey", "transaction_id", "evidence_id")


_NESTED = """concat('{"transaction_id":"', user_id, '","props":', props, ',"items":[{"evidence_id":"e', get_json_object(props, '$.k'), '","order_reference":"x","note":"mail  a@b.de id 123456789012"}],"deep":{"list":[{"transaction_ids":["', user_id + 1, '",', user_id + 2, '],"token":"t"}],"iban":{"raw":[1]}},"nothing":null}')"""
_IDS = dict(
    met="SELECT event_id, 0 AS place, user_id AS v FROM events UNION ALL SELECT event_id, 1, user_id + 1 FROM events UNION ALL SELECT event_id, 2, user_id + 2 FROM events",
    tx=f"SELECT v, 'tx_' || {_PSEUDONYM.format(n='n')} AS name FROM (SELECT v, row_number() OVER (ORDER BY min({{'a': event_id, 'b': place}})) AS n FROM met GROUP BY v)",
    ks="SELECT event_id, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    ev=f"SELECT k, 'ev_' || {_PSEUDONYM.format(n='n')} AS name FROM (SELECT k, row_number() OVER (ORDER BY min(event_id)) AS n FROM ks GROUP BY k)",
)


@query(with_(**_IDS) + """SELECT event_id, '{"transaction_id":"' || a.name || '","props":{"k":' || k || '},"items":[{"evidence_id":"' || ev.name || '","note":"mail [email] id [number]"}],"deep":{"list":[{"transaction_ids":["' || b.name || '","' || c.name || '"]}]}}' AS payload
       FROM ks JOIN ev USING (k) JOIN tx a ON a.v = user_id JOIN tx b ON b.v = user_id + 1 JOIN tx c ON c.v = user_id + 2""")
def redacted_payloads(t: Tables) -> DataFrame:
    """Events as nested payloads: banned keys at any depth, ids in objects and lists, numbered over all events."""
    return prompts.redacted(t.raw("events").selectExpr("event_id", f"{_NESTED} AS payload"), "event_id", "payload")


def _sanitised(text: str) -> str:
    for pattern, mark in SANITISERS:
        text = f"regexp_replace({text}, '{pattern}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    return f"left(trim(regexp_replace({text}, '\\s+', ' ', 'g')), 300)"


@query(f"""SELECT conv_id, 'tx_' || {_PSEUDONYM.format(n='rn')} AS transaction_id, turns, texts FROM (SELECT *, row_number() OVER (ORDER BY conv_id) AS rn FROM (SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || {_sanitised('text')}, '|' ORDER BY turn)) AS texts FROM conversations GROUP BY conv_id))""")
def redacted_conversations(t: Tables) -> DataFrame:
    """Whole conversations as one payload each; texts are sanitised wherever they stand."""
    turn = F.struct("turn", "role", "text", F.lit("x@y.de").alias("email"))
    talk = t.raw("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), F.struct(x["text"].alias("text"), x["email"].alias("email")).alias("said"))).alias("turns"))
    rows = talk.select("conv_id", F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("transaction_id"), "turns")).alias("payload"))
    clean = prompts.redacted(rows, "conv_id", "payload").withColumn("p", F.from_json("payload", "transaction_id string, turns array<struct<role: string, said: struct<text: string, email: string>>>"))
    said = F.transform("p.turns", lambda x: F.concat(x["role"], F.lit(":"), x["said"]["text"], F.coalesce(x["said"]["email"], F.lit(""))))
    return clean.select("conv_id", "p.transaction_id", F.size("p.turns").cast("long").alias("turns"), F.md5(F.array_join(said, "|")).alias("texts"))


_RAW = """CASE event_id % 4 WHEN 0 THEN concat('{"source_payload":{"id":"', event_id, '","ref":"', CASE WHEN event_id % 8 = 0 THEN 'r' ELSE '' END, '","user":{"no":', user_id, ',"tags":["', event_type, '","x",null,{"deep":true}]},"empty":{},"none":[]}}')
          WHEN 1 THEN concat('{"value":', CAST(value AS STRING), ',"user":{"no":', user_id, '}}') WHEN 2 THEN props ELSE 'no json' END"""
_PATHS = dict(
    v="""SELECT 'id' AS path, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'ref', 'r' FROM events WHERE event_id % 8 = 0
         UNION ALL SELECT 'user.no', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 IN (0, 1) UNION ALL SELECT 'user.tags[]', event_type FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'user.tags[]', 'x' FROM events WHERE event_id % 4 = 0
         UNION ALL SELECT 'user.tags[].deep', 'true' FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events WHERE event_id % 4 = 1 UNION ALL SELECT 'k', props->>'$.k' FROM events WHERE event_id % 4 = 2""",
    s="SELECT path, count(*) AS filled, count(DISTINCT value) AS n_values FROM v GROUP BY path UNION ALL SELECT 'reference', 0, 0",
)


@query(with_(**_PATHS) + "SELECT path, (SELECT count(*) FROM events) AS total, filled, n_values, round(filled / (SELECT count(*) FROM events), 4) AS fill_rate, round(coalesce(n_values / nullif(filled, 0), 0), 4) AS uniqueness, path IN ('id', 'reference') AS known FROM s")
def payload_profile(t: Tables) -> DataFrame:
    """Every scalar path of payloads of several shapes; the unmodified payload counts where a row holds one."""
    rows = t.raw("events").selectExpr(f"{_RAW} AS raw").select(F.coalesce(F.get_json_object("raw", "$.source_payload"), F.col("raw")).alias("payload"))
    return payloads.profile(rows, "payload", ["id", "reference"]).drop("sketch")


_WALK = dict(
    d="SELECT CAST(user_id AS VARCHAR) AS account, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2",
    a="SELECT DISTINCT CAST(user_id AS VARCHAR) AS account FROM events",
    e="SELECT account, CAST(unnest(range(DATE '2024-01-04', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS till FROM a",
    o="SELECT account, till, i, w, greatest(CAST(till - w + 1 AS DATE), DATE '2024-01-04') AS since FROM e, (VALUES (0, 8), (1, 4), (2, 2), (3, 1), (4, 1), (5, 1)) t(i, w)",
    c="SELECT o.account, o.till, i, w, since, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n FROM o LEFT JOIN d ON d.account = o.account AND d.day BETWEEN since AND till GROUP BY ALL",
    p="SELECT account, till, min(i) AS i FROM (SELECT account, till, CASE WHEN n < 7 THEN i ELSE 5 END AS i FROM c) GROUP BY ALL",
    b="SELECT c.*, c.n < 7 AS complete FROM c JOIN p USING (account, till, i)",
    r="""SELECT account, CAST(0 AS BIGINT) AS k, since, till, w, i, n, complete FROM b WHERE till = DATE '2024-01-29'
         UNION ALL SELECT b.account, r.k + 1, b.since, b.till, b.w, b.i, b.n, b.complete FROM r JOIN b ON b.account = r.account AND b.till = r.since - 1 WHERE r.complete AND r.since > DATE '2024-01-04'""",
)


def _windows(t: Tables) -> tuple[DataFrame, DataFrame]:
    bookings = t.raw("events").select(F.col("user_id").cast("string").alias("account"), F.col("ts").cast("date").alias("day"), "event_id")
    return backfill.walked(bookings.select("account").distinct(), bookings, "2024-01-04", "2024-01-29", width=8, page=7, strict=False), bookings


@query(recursive(**_WALK) + 'SELECT account, k AS "window", since AS "start", till AS "end", w AS width, i AS halvings, n, complete FROM r')
def backfill_walk(t: Tables) -> DataFrame:
    """Each user's events read back in windows of eight days, a page holding seven; some days are too full for any."""
    return _windows(t)[0]


@query(recursive(**_WALK) + 'SELECT event_id, k AS "window" FROM r JOIN events ON CAST(user_id AS VARCHAR) = account AND CAST(ts AS DATE) BETWEEN since AND till WHERE complete')
def backfill_rows(t: Tables) -> DataFrame:
    """Which window each event came in."""
    return backfill.read_back(*_windows(t)).select("event_id", "window")
