"""The driver's tables as a ledger, a portfolio and the rest of the model. Every definition has its SQL beside it, under the same name, for the differential check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS okey, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS booking_date,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS valuation_date,
       CAST(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(14,2)) AS amount,
       CASE o_orderkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'wallet' ELSE 'card' END AS source,
       CASE WHEN o_orderstatus = 'P' THEN c_name END AS sender, CASE WHEN o_orderstatus <> 'P' THEN c_name END AS recipient,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS category_id, o_orderpriority || ' ' || c_mktsegment AS description,
       (o_orderstatus = 'P' AND o_orderkey % 4 = 0) AS is_refund, (o_orderkey % 13 = 0) AS internal_transfer, (o_orderkey % 17 = 0) AS is_outlier
FROM orders JOIN customer ON o_custkey = c_custkey"""
CATEGORIES = "SELECT DISTINCT o_orderpriority AS category_id, lower(substr(o_orderpriority, 3)) AS name FROM orders"
#: category_id, name, monthly_limit, warning, critical, priority, is_active; the last but one has no rows at all.
BUDGETS = [
    ("1-URGENT", "urgent", "9000000.00", "0.80", "1.00", 5, True),
    ("2-HIGH", "high", "400000.00", "0.80", "1.00", 4, True),
    ("3-MEDIUM", "medium", "1200000.00", "0.50", "2.00", 3, True),
    ("4-NOT SPECIFIED", "not specified", "0.00", "0.80", "1.00", 2, True),
    ("6-NONE", "none", "100.00", "0.80", "1.00", 1, True),
    ("5-LOW", "low", "100.00", "0.80", "1.00", 0, False),
]
BUDGETS_SQL = "SELECT category_id, name, CAST(l AS DECIMAL(14,2)) AS monthly_limit, CAST(w AS DECIMAL(4,2)) AS warning, CAST(c AS DECIMAL(4,2)) AS critical, priority, is_active FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{x}', '{y}', '{z}', {p}, {str(t).lower()})" for a, b, x, y, z, p, t in BUDGETS) + ") t(category_id, name, l, w, c, priority, is_active)"
TAGS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'seven' AS tag FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'five' FROM orders WHERE o_orderkey % 5 = 0"
POSITIONS = """
SELECT CAST(s_nationkey AS BIGINT) AS depot_id, l_partkey AS isin, CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS quantity,
       CAST(sum(CAST(l_quantity * p_retailprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS current_value, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS purchase_value,
       CASE WHEN l_partkey % 3 <> 0 THEN CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) * 900 AS DECIMAL(18,2)) END AS prev_day_value,
       CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 5 * 300 AS DECIMAL(14,4)) END AS prev_day_price, max(CAST(l_shipdate AS DATE)) AS as_of
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_nationkey, l_partkey"""
INSTRUMENTS = "SELECT p_partkey AS isin, p_name AS name, CASE WHEN p_type LIKE 'STANDARD%' THEN 'SHARE' WHEN p_type LIKE 'SMALL%' THEN 'ETF' WHEN p_type LIKE 'LARGE%' THEN 'FUND' WHEN p_type LIKE 'PROMO%' THEN 'BOND' WHEN p_type LIKE 'MEDIUM%' THEN 'CERTIFICATE' END AS instrument_type FROM part"
TRADES = """
SELECT l_orderkey AS okey, l_linenumber AS line, CAST(s_nationkey AS BIGINT) AS depot_id, l_partkey AS isin, CAST(l_shipdate AS DATE) AS booking_date,
       CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'N' THEN 'SELL' WHEN 'R' THEN 'DIVIDEND' ELSE 'OTHER' END AS transaction_type, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount, l_quantity AS quantity
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
DEPOTS = "SELECT CAST(n_nationkey AS BIGINT) AS depot_id, n_name AS name FROM nation UNION ALL SELECT CAST(1000 AS BIGINT), 'EMPTY'"
#: Names of the definitions above, for WITH.
SQL = {"ledger": LEDGER, "categories": CATEGORIES, "budgets": BUDGETS_SQL, "tags": TAGS, "positions": POSITIONS, "instruments": INSTRUMENTS, "trades": TRADES, "depots": DEPOTS}


def with_(*names: str, **more: str) -> str:
    """A WITH clause of some of the definitions."""
    return "WITH " + ",\n".join(f"{n} AS ({q.strip()})" for n, q in [*((n, SQL[n]) for n in names), *more.items()]) + "\n"


class Tables:
    """The model over one folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ledger(self) -> DataFrame:
        o, c = self.raw("orders"), self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        credit, day = F.col("o_orderstatus") == "P", F.col("o_orderdate").cast("date")
        key = F.col("o_orderkey")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            key.cast("string").alias("id"), key.alias("okey"), F.col("o_custkey").alias("custkey"), day.alias("booking_date"), F.date_add(day, (key % 3).cast("int")).alias("valuation_date"), F.when(credit, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).cast("decimal(14,2)").alias("amount"),
            F.when(key % 3 == 0, "bank").when(key % 3 == 1, "wallet").otherwise("card").alias("source"), F.when(credit, F.col("c_name")).alias("sender"), F.when(~credit, F.col("c_name")).alias("recipient"), F.when(key % 10 != 0, F.col("o_orderpriority")).alias("category_id"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("description"), (credit & (key % 4 == 0)).alias("is_refund"), (key % 13 == 0).alias("internal_transfer"), (key % 17 == 0).alias("is_outlier"))

    def categories(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderpriority").alias("category_id"), F.lower(F.substring("o_orderpriority", 3, 100)).alias("name")).distinct()

    def budgets(self) -> DataFrame:
        rows = self.spark.createDataFrame(BUDGETS, "category_id string, name string, l string, w string, c string, priority int, is_active boolean")
        return rows.select("category_id", "name", F.col("l").cast("decimal(14,2)").alias("monthly_limit"), F.col("w").cast("decimal(4,2)").alias("warning"), F.col("c").cast("decimal(4,2)").alias("critical"), "priority", "is_active")

    def tags(self) -> DataFrame:
        key = F.col("o_orderkey")
        tags = F.array_compact(F.array(F.when(key % 7 == 0, "seven"), F.when(key % 5 == 0, "five")))
        return self.raw("orders").select(key.cast("string").alias("id"), F.explode(tags).alias("tag"))

    def positions(self) -> DataFrame:
        rows = self.raw("lineitem").join(self.raw("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.raw("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        sums = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("depot_id"), F.col("l_partkey").alias("isin")).agg(
            F.sum(F.col("l_quantity").cast("decimal(18,6)")).cast("decimal(18,6)").alias("quantity"), F.sum((F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)")).cast("decimal(18,2)").alias("current_value"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("purchase_value"), F.max(F.col("l_shipdate").cast("date")).alias("as_of"))
        before = F.when(F.col("isin") % 3 != 0, (F.col("quantity") * 900).cast("decimal(18,2)"))
        return sums.withColumns({"prev_day_value": before, "prev_day_price": F.when(F.col("isin") % 2 == 0, (F.col("isin") % 5 * 300).cast("decimal(14,4)"))})

    def instruments(self) -> DataFrame:
        kind = F.col("p_type")
        named = F.when(kind.startswith("STANDARD"), "SHARE").when(kind.startswith("SMALL"), "ETF").when(kind.startswith("LARGE"), "FUND").when(kind.startswith("PROMO"), "BOND").when(kind.startswith("MEDIUM"), "CERTIFICATE")
        return self.raw("part").select(F.col("p_partkey").alias("isin"), F.col("p_name").alias("name"), named.alias("instrument_type"))

    def trades(self) -> DataFrame:
        flag = F.col("l_returnflag")
        rows = self.raw("lineitem").join(self.raw("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("s_nationkey").cast("bigint").alias("depot_id"), F.col("l_partkey").alias("isin"), F.col("l_shipdate").cast("date").alias("booking_date"), F.when(flag == "A", "BUY").when(flag == "N", "SELL").when(flag == "R", "DIVIDEND").otherwise("OTHER").alias("transaction_type"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"), F.col("l_quantity").alias("quantity"))

    def depots(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("depot_id"), F.col("n_name").alias("name")).union(self.spark.createDataFrame([(1000, "EMPTY")], "depot_id bigint, name string"))
