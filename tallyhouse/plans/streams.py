"""Streams that end with their input; their answers equal those of batch queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.registry import query
from tallyhouse.sources.folders import fresh_folder
from tallyhouse.sources.tables import Tables, with_
from tallyhouse.sources.store import Store
from tallyhouse.streaming import chains, ingest


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """The events twice over; each comes out once."""
    stream = ingest.opened(t.spark, f"{t.folder}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    return ingest.deduplicated(stream.union(stream), ["event_id"], "ts", "60 days").select("event_id", "user_id", "event_type")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM events GROUP BY 1, 2")
def stream_totals(t: Tables) -> DataFrame:
    stream = ingest.opened(t.spark, f"{t.folder}/events.parquet")
    found = ingest.windowed_totals(stream, "ts", "1 day", ["event_type"], "value", delay="60 days")
    return found.select(F.col("start").cast("date").alias("day"), "event_type", "n", "total_cents")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS started FROM b GROUP BY user_id, s")
def user_sessions(t: Tables) -> DataFrame:
    found = ingest.sessions(t.raw("events").select("user_id", "ts"), "ts", "user_id")
    return found.select("user_id", "n", F.unix_timestamp("start").alias("started"))


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS hits FROM events) WHERE hits > 2")
def rate_limited(t: Tables) -> DataFrame:
    return ingest.over_limit(t.raw("events").select("event_id", "user_id", "ts"), "ts", "user_id", most=2, seconds=7200).select("event_id")


#: Files that a run of a stream takes at once: all there are.
_ALL_FILES = 1 << 30


def _arriving(t: Tables, owner: str) -> Iterator[DataFrame]:
    """Bookings that arrive in five loads, the later ones with corrections of what came before and some of it again: after each load the stream of all so far, which takes a load as one batch, however many tasks wrote it. Hashes are those of one ``owner`` each."""
    path = fresh_folder(t.spark, "arriving")
    rows = t.raw("events").selectExpr("event_type AS source", "CAST(user_id % 97 AS STRING) AS external_id", f"sha2(concat_ws('|', {owner}, CAST(event_id % 50 AS STRING)), 256) AS content_hash", "event_id AS arrival")
    last = rows.agg(F.max("arrival")).first()[0] + 1
    for k in range(5):  # one after the other, so that the stream reads them in this order
        rows.where(F.col("arrival").between(k * last // 5 - last // 50, (k + 1) * last // 5 - 1)).write.mode("append").parquet(path)
        yield ingest.opened(t.spark, path, _ALL_FILES)


def _chains(owner: str) -> str:
    return f"""WITH a AS (SELECT event_type AS source, CAST(user_id % 97 AS VARCHAR) AS external_id, sha256(concat_ws('|', {owner}, CAST(event_id % 50 AS VARCHAR))) AS content_hash, event_id AS arrival FROM events),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY arrival) = 1)
SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY arrival) AS version, lead(content_hash) OVER (PARTITION BY source, external_id ORDER BY arrival) AS superseded_by FROM f"""


@query(_chains("event_type, CAST(user_id % 97 AS VARCHAR)"))
def stream_versions(t: Tables) -> DataFrame:
    """A stream's version chains from keyed state: every row with its version and what supersedes it."""
    path = fresh_folder(t.spark, "chains")
    for stream in _arriving(t, "event_type, CAST(user_id % 97 AS STRING)"):
        found = chains.chained(stream, path)
    return found


@query(_chains("CAST(user_id % 7 AS VARCHAR)"))
def stream_store(t: Tables) -> DataFrame:
    """The same into stored tables, where a hash counts once whoever brings it."""
    store = Store(t.spark, fresh_folder(t.spark, "store"), 16)
    for stream in _arriving(t, "CAST(user_id % 7 AS STRING)"):
        chains.kept(stream, store)
    return store.read("versions")


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS income, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS expenses, count(*) AS n FROM events GROUP BY 1")
def stream_cashflow(t: Tables) -> DataFrame:
    stream = ingest.opened(t.spark, f"{t.folder}/events.parquet")
    return ingest.cashflow(stream.withColumn("amount", F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))), "ts", "amount")


@query("SELECT event_id AS event FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS hits FROM events) WHERE hits > 2")
def stream_rate_limited(t: Tables) -> DataFrame:
    return ingest.limited(ingest.opened(t.spark, f"{t.folder}/events.parquet"), "event_id", "ts", "user_id", most=2, seconds=7200).select("event")


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY user_id HAVING floor(epoch(max(ts))) + 86400 < (SELECT floor(epoch(max(ts))) - 1 FROM events)")
def stream_stalled(t: Tables) -> DataFrame:
    return ingest.stalled(ingest.opened(t.spark, f"{t.folder}/events.parquet").select("user_id", "ts"), "user_id", "ts", 86400).select("key", "last")
