"""Depots, positions, prices and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money
from tallyhouse.operators import portfolio as P
from tallyhouse.operators import versions
from tallyhouse.plans.registry import query
from tallyhouse.plans.reporting import m, r
from tallyhouse.sources.tables import Tables, with_

TODAY = "1998-12-31"
_BUCKET = "CASE WHEN instrument_type IN ('SHARE', 'STOCK') THEN 'Aktien' WHEN instrument_type IN ('ETF', 'FUND') THEN 'ETFs' WHEN instrument_type IN ('BOND', 'BONDS') THEN 'Anleihen' ELSE 'Sonstiges' END"


_BEFORE = "SELECT *, CASE WHEN coalesce(prev_day_value, CASE WHEN prev_day_price <> 0 THEN prev_day_price * quantity END) > 0 THEN coalesce(CAST(prev_day_value AS DECIMAL(28,6)), CAST(prev_day_price * quantity AS DECIMAL(28,6))) END AS before FROM positions"


@query(with_("positions", "depots", x=_BEFORE, s=f"SELECT {m('sum(current_value)')} AS value, {m('sum(purchase_value)')} AS purchase, {m('sum(current_value - before)')} AS daily_gain, {m('sum(before)')} AS before, count(*) AS n, max(as_of) AS last_as_of FROM x")
       + f"SELECT value, purchase, CAST(value - purchase AS DECIMAL(18,2)) AS gain, {r('(value - purchase) * 100', 'purchase', 2)} AS gain_pct, daily_gain, {r('daily_gain * 100', 'before', 2)} AS daily_gain_pct, n, (SELECT count(*) FROM depots) AS depots, last_as_of FROM s")
def portfolio_summary(t: Tables) -> DataFrame:
    return P.summary(t.positions(), t.depots())


@query(with_("positions", "instruments", s=f"SELECT {_BUCKET} AS bucket, {m('sum(current_value)')} AS value FROM positions JOIN instruments USING (isin) GROUP BY 1") + f"SELECT bucket, value, {r('value * 100', '(SELECT sum(value) FROM s)', 2)} AS share_pct FROM s WHERE value > 0")
def allocation(t: Tables) -> DataFrame:
    return P.allocation(t.positions(), t.instruments()).orderBy(F.desc("value"))


@query(with_("depots", "positions", s="SELECT depot_id, sum(current_value) AS v, sum(purchase_value) AS p, count(*) AS n, max(as_of) AS as_of FROM positions GROUP BY 1") + f"SELECT depot_id, as_of, {m('v')} AS value, {m('p')} AS purchase, coalesce(n, 0) AS n, CAST({m('v')} - {m('p')} AS DECIMAL(18,2)) AS gain FROM depots LEFT JOIN s USING (depot_id)")
def depot_totals(t: Tables) -> DataFrame:
    return P.depot_totals(t.depots(), t.positions())


@query(with_("positions", "instruments", x=_BEFORE) + f"SELECT depot_id, isin, name, CAST(current_value AS DECIMAL(18,2)) AS value, CAST(current_value - purchase_value AS DECIMAL(18,2)) AS gain, {r('(current_value - purchase_value) * 100', 'purchase_value', 2)} AS gain_pct, CAST(current_value - before AS DECIMAL(18,2)) AS daily_gain, {r('current_value * 100', 'sum(current_value) OVER (PARTITION BY depot_id)', 2)} AS weight_pct FROM x JOIN instruments USING (isin)")
def position_gains(t: Tables) -> DataFrame:
    return P.position_gains(t.positions(), t.instruments())


@query(with_("depots", "positions") + f"SELECT d.depot_id, {m('sum(current_value)')} AS total_value, {m('sum(purchase_value)')} AS total_purchase_value FROM depots d LEFT JOIN positions p ON d.depot_id = p.depot_id GROUP BY ROLLUP (d.depot_id)")
def portfolio_snapshots(t: Tables) -> DataFrame:
    return P.snapshots(t.depots(), t.positions())


_TAKEN = "SELECT d.depot_id, DATE '{day}' AS snapshot_date, " + m("sum(current_value)") + " AS total_value, " + m("sum(purchase_value)") + " AS total_purchase_value FROM depots d LEFT JOIN (SELECT * FROM positions WHERE {which}) p ON d.depot_id = p.depot_id GROUP BY ROLLUP (d.depot_id)"


@query(with_("depots", "positions") + f"{_TAKEN.format(day='1998-12-29', which='isin % 2 = 0')} UNION ALL {_TAKEN.format(day='1998-12-30', which='true')}")
def snapshot_series(t: Tables) -> DataFrame:
    """Snapshots of two days, the first taken twice; a day's second one counts."""
    depots, positions = t.depots(), t.positions()
    kept = P.taken(depots, positions.where("isin % 3 = 0"), "1998-12-29")
    for day, which in (("1998-12-29", "isin % 2 = 0"), ("1998-12-30", "true")):
        kept = P.keep_snapshots(kept, P.taken(depots, positions.where(which), day))
    return kept


_LIMITS = "SELECT category_id, CAST(round(sum(abs(amount)) / 12, 0) AS DECIMAL(14,2)) AS monthly_limit FROM ledger WHERE category_id IS NOT NULL GROUP BY 1"


@query(with_("ledger", "budgets", i=_LIMITS) + "SELECT category_id, coalesce(i.monthly_limit, b.monthly_limit) AS monthly_limit, coalesce(b.warning, 0.8) AS warning, coalesce(b.name, category_id) AS name FROM budgets b FULL JOIN i USING (category_id)")
def budgets_upserted(t: Tables) -> DataFrame:
    """Budgets whose limits are learned from the ledger: one of a category that has a budget keeps its name and its warning."""
    stored = t.budgets().select("category_id", "monthly_limit", "warning", "name")
    sums = t.ledger().where("category_id is not null").groupBy("category_id").agg(F.round(F.sum(F.abs("amount")) / 12, 0).cast("decimal(14,2)").alias("monthly_limit"))
    return versions.upsert(stored, sums.select("category_id", "monthly_limit", F.lit("0.8").cast("decimal(4,2)").alias("warning"), F.col("category_id").alias("name")), ["category_id"], fixed=["warning", "name"])


_DAILY = "SELECT CAST(NULL AS BIGINT) AS depot_id, booking_date AS snapshot_date, sum(amount) AS v FROM trades GROUP BY 2 UNION ALL SELECT depot_id, booking_date, sum(amount) FROM trades GROUP BY 1, 2"


@query(with_("trades", s=_DAILY) + f"SELECT snapshot_date, {m('v')} AS value FROM s WHERE depot_id IS NULL AND snapshot_date BETWEEN DATE '{TODAY}' - 31 AND DATE '{TODAY}'")
def performance_range(t: Tables) -> DataFrame:
    daily = t.trades().groupingSets([["depot_id", "booking_date"], ["booking_date"]], "depot_id", "booking_date").agg(F.sum("amount").alias("v")).withColumnRenamed("booking_date", "snapshot_date")
    return P.performance(daily, "1M", TODAY).select("snapshot_date", money(F.col("v")).alias("value"))


@query(with_("trades", "positions", d=f"SELECT {m('sum(amount)')} AS dividends FROM trades WHERE transaction_type = 'DIVIDEND' AND booking_date BETWEEN DATE '1995-12-31' - 365 AND DATE '1995-12-31'", v=f"SELECT {m('sum(current_value)')} AS value FROM positions") + f"SELECT dividends, value, {r('dividends * 100', 'value', 2)} AS yield_pct FROM d, v")
def dividend_yield(t: Tables) -> DataFrame:
    return P.dividend_yield(t.trades(), t.positions(), "1995-12-31")


_PLANS = "SELECT p_partkey AS isin, CAST(p_size AS DECIMAL(14,2)) AS amount, CASE p_partkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS interval_, p_partkey % 4 <> 0 AS active FROM part WHERE p_partkey % 5 = 0"


def _plans(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.raw("part").where("p_partkey % 5 = 0").select(key.alias("isin"), F.col("p_size").cast("decimal(14,2)").alias("amount"), F.when(key % 3 == 0, "monthly").when(key % 3 == 1, "quarterly").otherwise("yearly").alias("interval"), (key % 4 != 0).alias("active"))


@query(f"WITH p AS ({_PLANS}) SELECT round(coalesce(sum(CASE WHEN NOT active THEN 0 WHEN interval_ = 'quarterly' THEN CAST(amount AS DOUBLE) / 3 WHEN interval_ = 'yearly' THEN CAST(amount AS DOUBLE) / 12 ELSE CAST(amount AS DOUBLE) END), 0), 2) AS monthly_savings, CAST(count_if(active) AS BIGINT) AS active_plans FROM p")
def monthly_savings(t: Tables) -> DataFrame:
    return P.monthly_savings(_plans(t))


@query(f"WITH p AS ({_PLANS}) SELECT isin, p_name AS name, amount, active FROM p JOIN part ON p_partkey = isin")
def savings_plans(t: Tables) -> DataFrame:
    return _plans(t).join(t.instruments(), "isin").select("isin", "name", "amount", "active").orderBy("name")


_TARGETS = "SELECT 'bucket' AS kind, b AS k, CAST(t AS DECIMAL(6,2)) AS target_pct, CAST(NULL AS DECIMAL(6,2)) AS max_pct FROM (VALUES ('Aktien', 0.5), ('ETFs', 40.0)) x(b, t)"
_REPORT = dict(
    pl=_PLANS,
    h=f"SELECT isin, v, name, instrument_type, {_BUCKET} AS bucket, {r('v * 100', 'sum(v) OVER ()', 4)} AS weight_pct FROM (SELECT isin, sum(current_value) AS v FROM positions GROUP BY 1) JOIN instruments USING (isin)",
    j="SELECT h.*, CASE WHEN isin % 50 = 0 THEN 0.01 WHEN bucket = 'Aktien' THEN 0.5 WHEN bucket = 'ETFs' THEN 40.0 END::DOUBLE AS target_pct, CASE WHEN isin % 50 = 0 THEN 0.06 END::DOUBLE AS max_pct, EXISTS (SELECT 1 FROM pl WHERE pl.isin = h.isin AND active) AS has_plan FROM h",
    report=f"SELECT isin, name, bucket, CAST(v AS DECIMAL(18,2)) AS value, weight_pct, target_pct, round(target_pct - weight_pct, 4) AS gap_pct, NOT coalesce(instrument_type IN ('ETF', 'FUND') OR contains(lower(name), 'etf'), false) AND weight_pct > 0.05 AND (max_pct IS NULL OR weight_pct > max_pct) AS over_cap, has_plan FROM j",
)


def _report(t: Tables) -> DataFrame:
    own = t.instruments().where("isin % 50 = 0").select(F.lit("isin").alias("target_type"), F.col("isin").cast("string").alias("target_key"), F.lit("0.01").cast("decimal(6,2)").alias("target_pct"), F.lit("0.06").cast("decimal(6,2)").alias("max_pct"))
    group = t.spark.createDataFrame([("bucket", "Aktien", "0.5"), ("bucket", "ETFs", "40.0")], "target_type string, target_key string, x string").select("target_type", "target_key", F.col("x").cast("decimal(6,2)").alias("target_pct"), F.lit(None).cast("decimal(6,2)").alias("max_pct"))
    return P.plan_report(t.positions(), t.instruments(), own.union(group), _plans(t), cap_pct=0.05)


@query(with_("positions", "instruments", **_REPORT) + "SELECT * FROM report")
def plan_report(t: Tables) -> DataFrame:
    return _report(t)


@query(with_("positions", "instruments", **_REPORT) + "SELECT isin, 'pause_savings_plan' AS kind, 'warning' AS severity FROM report WHERE over_cap AND has_plan UNION ALL SELECT isin, 'prioritize_underweight', 'info' FROM report WHERE gap_pct > 0.5")
def plan_suggestions(t: Tables) -> DataFrame:
    return P.plan_suggestions(_report(t))


@query("WITH a AS (SELECT l_partkey AS isin, 'p' || max(l_suppkey) AS name, 'SHARE' AS instrument_type FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS isin, 't' || max(l_suppkey) AS name, 'OTHER' AS instrument_type FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE isin NOT IN (SELECT isin FROM a)")
def instrument_union(t: Tables) -> DataFrame:
    rows = t.raw("lineitem")
    side = lambda k, letter, kind: rows.where(F.col("l_partkey") % k == 0).select(F.col("l_partkey").alias("isin"), F.concat(F.lit(letter), F.col("l_suppkey").cast("string")).alias("name"), F.lit(kind).alias("instrument_type"), F.col("l_suppkey").alias("seq"))
    return P.instruments(side(2, "p", "SHARE"), side(3, "t", "OTHER"))


_FETCHED = "SELECT l_partkey AS isin, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DECIMAL(14,4)) AS close FROM lineitem"
_WANTED = dict(f=_FETCHED, w="SELECT * FROM f WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", n="SELECT isin, date, min(close) AS close FROM w WHERE isin % 2 = 1 GROUP BY 1, 2")


def _fetched(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(F.col("l_partkey").alias("isin"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("decimal(14,4)").alias("close"))


@query("WITH " + ", ".join(f"{k} AS ({v})" for k, v in _WANTED.items()) + " SELECT isin, date, CAST(close AS DECIMAL(18,4)) AS close FROM n")
def price_backfill(t: Tables) -> DataFrame:
    rows = _fetched(t)
    new, _ = P.price_backfill(rows.where("isin % 2 = 0"), rows, "1997-01-01", "1997-12-31")
    return new.select("isin", "date", F.col("close").cast("decimal(18,4)").alias("close"))


@query("WITH " + ", ".join(f"{k} AS ({v})" for k, v in _WANTED.items()) + " SELECT (SELECT count(*) FROM w) AS fetched, (SELECT count(*) FROM n) AS inserted, (SELECT count(*) FROM w) - (SELECT count(*) FROM n) AS skipped")
def price_backfill_counts(t: Tables) -> DataFrame:
    rows = _fetched(t)
    return P.price_backfill(rows.where("isin % 2 = 0"), rows, "1997-01-01", "1997-12-31")[1]


@query("WITH f AS (" + _FETCHED + ") SELECT isin, date, CAST(min(close) AS DECIMAL(18,4)) AS close FROM f WHERE isin = 7 AND date >= DATE '1996-01-01' AND date < DATE '1999-01-01' GROUP BY 1, 2")
def price_series(t: Tables) -> DataFrame:
    rows = _fetched(t).where("isin = 7 and date >= date'1996-01-01' and date < date'1999-01-01'")
    return rows.groupBy("isin", "date").agg(F.min("close").cast("decimal(18,4)").alias("close")).orderBy("date")


@query(with_("trades", "instruments") + f"SELECT okey, line, booking_date, transaction_type, CAST(amount AS DECIMAL(18,2)) AS amount, name FROM trades LEFT JOIN instruments USING (isin) WHERE depot_id = 3 ORDER BY booking_date DESC, okey DESC, line DESC, amount DESC LIMIT 20")
def activities_page(t: Tables) -> DataFrame:
    rows = t.trades().where("depot_id = 3").join(t.instruments(), "isin", "left")
    return rows.select("okey", "line", "booking_date", "transaction_type", money(F.col("amount")).alias("amount"), "name").orderBy(F.desc("booking_date"), F.desc("okey"), F.desc("line"), F.desc("amount")).limit(20)


@query(with_("trades") + "SELECT depot_id, transaction_type, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM trades GROUP BY 1, 2")
def trades_by_type(t: Tables) -> DataFrame:
    return t.trades().groupBy("depot_id", "transaction_type").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


@query(with_("positions") + "SELECT depot_id, isin, CAST(current_value AS DECIMAL(18,2)) AS value FROM positions WHERE depot_id >= 10 OR isin % 2 = 0 AND depot_id < 5 OR depot_id BETWEEN 5 AND 9")
def replaced_positions(t: Tables) -> DataFrame:
    """Depots below 5 come in again with every other position; theirs are replaced, the others stay."""
    rows = t.positions().select("depot_id", "isin", money(F.col("current_value")).alias("value"))
    return versions.replace_groups(rows, rows.where("depot_id < 5 and isin % 2 = 0"), "depot_id")


@query(with_("trades") + "SELECT okey, min(line) AS line FROM trades GROUP BY okey")
def inserted_trades(t: Tables) -> DataFrame:
    rows = t.trades().groupBy("okey").agg(F.min("line").alias("line"))
    return versions.insert_absent(rows.where("okey % 2 = 0"), rows.union(rows), ["okey"])
