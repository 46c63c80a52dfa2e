"""The book of runs over times that lie just before a second."""

import duckdb
from pyspark.sql import functions as F

from tallyhouse.operators import changes
from tallyhouse.plans import changes as _  # noqa: F401
from tallyhouse.plans.registry import ORACLES, QUERIES


def test_run_book_rounds_times_as_its_sql(spark, tmp_path):
    made = duckdb.connect()
    made.execute("create table events as select i as event_id, timestamp '2024-01-01 00:00:00' + to_microseconds(i * 3600000000 + case i % 3 when 0 then 999500 when 1 then 999499 else 999999 end) as ts, i // 12 as user_id from range(240) t(i)")
    made.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = sorted(map(tuple, QUERIES["run_book"](spark, str(tmp_path)).select("run_id", "status", "began", "beat").collect()))
    assert got == sorted(made.sql(ORACLES["run_book"]).select("run_id, status, began, beat").fetchall())


def test_finishes_at_one_time(spark):
    """A failure among finishes of one time is one, whatever comes first."""
    rows = [("a", "finished", 9, 1, None), ("a", "finished", 9, 2, "broken"), ("a", "finished", 3, 7, "old"), ("b", "finished", 9, 2, "broken"), ("b", "finished", 9, 9, None), ("c", "finished", 9, 1, "x"), ("c", "finished", 10, 1, None), ("d", "beat", 1, None, None)]
    events = spark.createDataFrame(rows, "run_id string, kind string, s long, rows int, error string").withColumn("at", F.timestamp_seconds("s")).withColumn("source", F.lit("bank")).drop("s")
    nothing = spark.createDataFrame([], "run_id string, source string, status string, started_at timestamp, finished_at timestamp, heartbeat_at timestamp, rows int, error string")
    for order in (events, events.orderBy(F.desc("rows"))):
        assert {r["run_id"]: (r["status"], r["error"]) for r in changes.run_events(nothing, order.coalesce(1)).collect()} == {"a": ("failed", "broken"), "b": ("failed", "broken"), "c": ("completed", None), "d": ("running", None)}
