"""Rows that belong together. The SQL decides step by step with recursion, as a person going through the bookings would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import pairing
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_

#: A year of bookings in some 50 days, so that windows hold many rows.
_DAY = "date_add(DATE'2000-01-01', CAST(floor(datediff(booking_date, DATE'1992-01-01') / {n}) AS INT))"
_DAY_SQL = "CAST(DATE '2000-01-01' + CAST(floor(date_diff('day', DATE '1992-01-01', booking_date) / {n}) AS INTEGER) AS DATE)"


def recursive(*names: str, **more: str) -> str:
    return with_(*names, **more).replace("WITH", "WITH RECURSIVE", 1)


def _greedy(legs: str) -> dict[str, str]:
    """Pairs of ``legs`` (id, c, day, credit): the credits of a day, in order, take the free debits of the window, in order."""
    return dict(
        legs=legs,
        cr="SELECT c, day, list(id ORDER BY id) AS ids, row_number() OVER (PARTITION BY c ORDER BY day) AS k FROM legs WHERE credit GROUP BY c, day",
        cw="SELECT *, coalesce(lag(day) OVER (PARTITION BY c ORDER BY k), DATE '1900-01-01') AS previous FROM cr",
        step="SELECT w.c, w.k, any_value(w.day) AS day, any_value(w.ids) AS ids, coalesce(list({'day': d.day, 'id': d.id} ORDER BY d.day, d.id) FILTER (WHERE d.id IS NOT NULL), []) AS come FROM cw w LEFT JOIN legs d ON d.c = w.c AND NOT d.credit AND d.day <= w.day + 2 AND d.day > w.previous + 2 GROUP BY w.c, w.k",
        r="""SELECT c, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(day DATE, id VARCHAR)[]) AS free, CAST([] AS STRUCT(credit_id VARCHAR, debit_id VARCHAR)[]) AS pairs FROM (SELECT DISTINCT c FROM step)
             UNION ALL SELECT c, k, left_over[least(len(ids), len(left_over)) + 1:], list_transform(range(1, least(len(ids), len(left_over)) + 1), lambda i: {'credit_id': ids[i], 'debit_id': left_over[i].id})
             FROM (SELECT s.c, s.k, s.ids, list_filter(r.free || s.come, lambda x: x.day >= s.day - 2) AS left_over FROM r JOIN step s ON s.c = r.c AND s.k = r.k + 1)""",
        met="SELECT unnest(pairs, recursive := true) FROM r",
    )


_C = "CASE WHEN okey % 3 = 0 THEN 100 ELSE okey % 700 + 1 END"
_LEGS = _greedy(
    f"SELECT 'd' || id AS id, {_C} AS c, {_DAY_SQL.format(n=7)} AS day, false AS credit FROM ledger UNION ALL SELECT 'c' || id, {_C}, CAST({_DAY_SQL.format(n=7)} + CAST(okey % 4 AS INTEGER) AS DATE), true FROM ledger"
)


def _legs(t: Tables) -> DataFrame:
    """Each order as a debit, and its mirror as a credit 0 to 3 days later; a third of all have one amount."""
    o = t.ledger().selectExpr("id", "okey", "'DE' || CAST(custkey AS STRING) AS other", f"CAST({_C} AS DECIMAL(14,2)) AS c", f"{_DAY.format(n=7)} AS day")
    debit = o.selectExpr("'d' || id AS id", "-c AS amount", "day AS booking_date", "other AS sender_iban", "'DE0' AS recipient_iban")
    return debit.union(o.selectExpr("'c' || id", "c", "date_add(day, CAST(okey % 4 AS INT))", "'DE0'", "other"))


@query(recursive("ledger", **_LEGS) + "SELECT credit_id, debit_id FROM met")
def internal_transfers(t: Tables) -> DataFrame:
    return pairing.internal_transfers(_legs(t), ["DE0"])


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('link:internal_transfer:' || credit_id || ':' || debit_id))"


@query(recursive("ledger", **_LEGS, h=f"SELECT credit_id, debit_id, {_SHA} AS h FROM met")
       + "SELECT credit_id, debit_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS link_id FROM h")
def transfer_links(t: Tables) -> DataFrame:
    """The pairs of internal transfers with their stable link ids."""
    return pairing.internal_transfers(_legs(t), ["DE0"]).withColumn("link_id", pairing.link_id(F.lit("internal_transfer"), F.col("credit_id"), F.col("debit_id")))


_TOP_UPS = _greedy(f"SELECT id, custkey % 40 + 1 AS c, {_DAY_SQL.format(n=3)} AS day, source = 'wallet' AS credit FROM ledger WHERE (source = 'wallet' AND amount < -100000) OR source = 'bank'")


@query(recursive("ledger", **_TOP_UPS) + "SELECT credit_id, debit_id FROM met")
def wallet_top_ups(t: Tables) -> DataFrame:
    """Bookings of the wallet over some size came from the bank; which of its debits paid for each?"""
    sign = F.when((F.col("source") == "wallet") & (F.col("amount") < -100000), 1).when(F.col("source") == "bank", -1).otherwise(0)
    rows = t.ledger().withColumns({"booking_date": F.expr(_DAY.format(n=3)), "amount": (sign * (F.col("custkey") % 40 + 1)).cast("decimal(14,2)")})
    return pairing.top_ups(rows, F.col("source") == "wallet", F.col("source") == "bank")


_DETAIL = "CASE WHEN okey % 7 = 0 THEN 0 WHEN custkey % 2 = 0 THEN okey % 13 + 1 ELSE abs(amount) END"
_SUBSETS = dict(
    d=f"SELECT custkey AS account, id, {_DAY_SQL.format(n=40)} AS day, -CAST({_DETAIL} * 100 AS BIGINT) AS c FROM ledger WHERE source <> 'card'",
    s="SELECT account, 'p' || min(id) AS id, max(day) AS day, CAST(sum(c) AS BIGINT) AS target FROM d GROUP BY account, floor(date_diff('day', DATE '2000-01-01', day) / 2)",
    pa="SELECT * FROM s WHERE target <> 0 UNION ALL SELECT account, 'q' || id, day, target FROM s WHERE target <> 0 AND account % 3 = 0",
    pk="SELECT *, row_number() OVER (PARTITION BY account ORDER BY day, id) AS k FROM pa",
    st="SELECT p.account, p.k, any_value(p.id) AS parent, any_value(p.target) AS target, list({'id': d.id, 'c': d.c} ORDER BY d.day, d.id) AS near FROM pk p JOIN d ON d.account = p.account AND d.c <> 0 AND abs(date_diff('day', p.day, d.day)) <= 2 GROUP BY p.account, p.k",
    r="""SELECT DISTINCT account, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS parent, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS taken FROM pk
         UNION ALL SELECT account, k, parent, used || coalesce(found, []), coalesce(found, []) FROM (SELECT account, k, parent, used, CASE WHEN len(masks) = 1 THEN list_transform(list_filter(range(0, len(free)), lambda j: (masks[1] >> j) & 1 = 1), lambda j: free[j + 1].id) END AS found
         FROM (SELECT *, list_filter(range(1, CASE WHEN len(free) > 18 THEN 1 ELSE 1 << len(free) END), lambda m: list_sum(list_transform(range(0, len(free)), lambda j: CASE WHEN (m >> j) & 1 = 1 THEN free[j + 1].c ELSE 0 END)) = target) AS masks
         FROM (SELECT r.account, r.k + 1 AS k, s.parent, s.target, r.used, list_filter(coalesce(s.near, []), lambda x: NOT list_contains(r.used, x.id)) AS free FROM r JOIN pk p ON p.account = r.account AND p.k = r.k + 1 LEFT JOIN st s ON s.account = r.account AND s.k = r.k + 1)))""",
)


@query(recursive("ledger", **_SUBSETS) + "SELECT parent AS parent_id, unnest(taken) AS child_id FROM r")
def collective_debits(t: Tables) -> DataFrame:
    """Sums of a customer's bookings of two days as debits, some of which come twice; bookings of no amount are among them."""
    details = t.ledger().where("source <> 'card'").selectExpr("custkey", "id", f"{_DAY.format(n=40)} AS booking_date", f"CAST(-{_DETAIL} AS DECIMAL(14,2)) AS amount")
    sums = details.groupBy("custkey", F.floor(F.datediff("booking_date", F.lit("2000-01-01").cast("date")) / 2)).agg(F.concat(F.lit("p"), F.min("id")).alias("id"), F.max("booking_date").alias("booking_date"), F.sum("amount").cast("decimal(14,2)").alias("amount")).where("amount <> 0")
    once = sums.select("id", "custkey", "booking_date", "amount")
    return pairing.collective_debits(once.union(once.where("custkey % 3 = 0").withColumn("id", F.concat(F.lit("q"), "id"))), details, "custkey")


_CYCLES = dict(
    cy="SELECT date_trunc('month', booking_date)::DATE AS cycle, CAST(sum(CAST(amount * 100 AS BIGINT)) % 9 * 100 AS BIGINT) AS net, min(booking_date) AS first, count(*) AS n FROM ledger WHERE source = 'card' GROUP BY 1",
    db="SELECT id, booking_date, okey % 9 * 100 AS c, row_number() OVER (PARTITION BY okey % 9 ORDER BY booking_date, id) AS k FROM ledger WHERE source = 'bank' AND okey % 9 <> 0",
    r="""SELECT DISTINCT c, CAST(0 AS BIGINT) AS k, NULL::VARCHAR AS debit_id, NULL::DATE AS cycle, CAST([] AS DATE[]) AS used FROM db
         UNION ALL SELECT c, k, id, CASE WHEN len(fit) = 1 THEN fit[1] END, CASE WHEN len(fit) = 1 THEN used || fit ELSE used END
         FROM (SELECT r.c, d.k, d.id, r.used, list_filter(coalesce(e.open, []), lambda x: NOT list_contains(r.used, x)) AS fit FROM r JOIN db d ON d.c = r.c AND d.k = r.k + 1 LEFT JOIN el e ON e.c = d.c AND e.k = d.k)""",
)
_CYCLES = {"cy": _CYCLES["cy"], "db": _CYCLES["db"], "el": "SELECT d.c, d.k, list(cycle) AS open FROM db d JOIN cy ON abs(net) = d.c AND d.booking_date >= first - 3 GROUP BY d.c, d.k", "r": _CYCLES["r"]}


@query(recursive("ledger", **_CYCLES) + "SELECT debit_id, cycle, CAST(r.c AS BIGINT) AS cents, n FROM r JOIN cy USING (cycle)")
def card_settlements(t: Tables) -> DataFrame:
    """Months of a card whose balances are few and often equal, of either sign, against all debits of the bank."""
    cycles = pairing.card_cycles(t.ledger().where("source = 'card'")).withColumn("net_cents", F.col("net_cents") % 9 * 100)
    debits = t.ledger().where("source = 'bank'").select("id", "booking_date", (-(F.col("okey") % 9)).cast("decimal(18,2)").alias("amount"))
    return pairing.settlements(cycles, debits)
