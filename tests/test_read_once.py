"""What is known of rows is not worked out again for every step that uses it."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.operators import enrich, normalise, ordering, versions


def test_bookings_that_were_read_are_not_read_again(spark):
    canonical = ", ".join(f"{f} {'date' if f.endswith('date') else 'decimal(14,2)' if f.endswith('amount') else 'string'}" for f in normalise.FIELDS[1:])
    kept = ("1", date(2026, 5, 1), None, Decimal("-1.50"), "EUR", None, "Shop", None, None, "text", None, None)
    rows = [("bank", "not JSON", "h1", None, kept, True), ("bank", '{"transactionId": "2", "bookingDate": "2026-05-02", "transactionValue": {"value": "3.00"}}', "h2", None, None, False)]
    raw = spark.createDataFrame(rows, f"source string, raw string, content_hash string, superseded_by string, canonical struct<{canonical.replace(' ', ':').replace(',:', ', ')}>, is_read boolean")
    found = {r["id"]: (r["external_id"], r["valuation_date"], r["amount"]) for r in normalise.frame(raw).collect()}
    assert found == {"h1": ("1", date(2026, 5, 1), Decimal("-1.50")), "h2": ("2", date(2026, 5, 2), Decimal("3.00"))}


def test_outliers_work_out_their_rows_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(k):
        seen.add(1)
        return float(k * k)

    rows = spark.range(40).select("id", (F.col("id") % 2).alias("g"), value.asNondeterministic()(F.col("id")).alias("v"))
    assert enrich.outliers(rows, "g", "v", threshold=1.5).count() > 0
    assert seen.value <= 80


def test_rows_without_an_external_id_stand_alone(spark):
    rows = spark.createDataFrame([("bank", None, "a", 1), ("bank", None, "b", 2), ("bank", None, "a", 3), ("bank", "x", "c", 1), ("bank", "x", "d", 2)], "source string, external_id string, content_hash string, arrival long")
    found = {(r["content_hash"], r["arrival"]): (r["version"], r["superseded_by"]) for r in versions.versions(rows).collect()}
    assert found == {("a", 1): (1, None), ("b", 2): (1, None), ("c", 1): (1, "d"), ("d", 2): (2, None)}


def test_numbered_rows_are_not_shuffled_again_for_their_numbers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        found = ordering.numbered(rows, ["k"], ["text"], "n")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert found.groupBy("k").agg(F.min("n"), F.max("n"), F.countDistinct("n")).orderBy("k").collect() == [(k, 1, n, n) for k, n in enumerate((6667, 6667, 6666))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
