"""Reports over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import cents, money, ratio
from tallyhouse.operators import ledger as L
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_

#: The period that reports look at, and the day they are made on.
START, END, TODAY = "1998-01-01", "1998-12-31", "1998-12-31"
IN_PERIOD = f"booking_date BETWEEN DATE '{START}' AND DATE '{END}'"
INCOME = "sum(CASE WHEN amount > 0 AND NOT is_refund THEN amount END)"
EXPENSE = "sum(CASE WHEN amount < 0 OR is_refund THEN amount END)"


def m(x: str) -> str:
    return f"CAST(coalesce({x}, 0) AS DECIMAL(18,2))"


def r(a: str, b: str, digits: int = 4) -> str:
    return f"coalesce(round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits}), 0.0)"


@query(with_("ledger") + f"SELECT year(booking_date) AS year, month(booking_date) AS month, {m(INCOME)} AS income, {m(EXPENSE)} AS expenses, count(*) AS n, CAST({m(INCOME)} + {m(EXPENSE)} AS DECIMAL(18,2)) AS net FROM ledger WHERE NOT internal_transfer GROUP BY 1, 2")
def cashflow_over_time(t: Tables) -> DataFrame:
    return L.cashflow(t.ledger()).orderBy("year", "month")


_SUMS = f"SELECT {m(INCOME)} AS income, {m(EXPENSE)} AS expenses, count(*) AS n FROM ledger WHERE NOT internal_transfer AND {IN_PERIOD}"


@query(with_("ledger", s=_SUMS, u="SELECT *, CAST(income + expenses AS DECIMAL(18,2)) AS net FROM s") + f"SELECT *, {r('net', 'income')} AS savings_rate, CASE WHEN income > 0 THEN {r('net * 100', 'income', 1)} ELSE 0.0 END AS savings_rate_pct FROM u")
def period_summary(t: Tables) -> DataFrame:
    return L.summary(L.between(t.ledger(), START, END))


@query(with_("ledger", "categories") + f"SELECT category_id, name, {m('sum(amount)')} AS total, count(*) AS n FROM ledger JOIN categories USING (category_id) WHERE NOT internal_transfer AND {IN_PERIOD} GROUP BY 1, 2")
def summary_by_category(t: Tables) -> DataFrame:
    return L.by_category(L.between(t.ledger(), START, END), t.categories()).orderBy("total")


@query(with_("ledger") + f"SELECT strftime(booking_date, '%Y-%m') AS month, {m(INCOME)} AS income, {m(EXPENSE)} AS expenses FROM ledger WHERE NOT internal_transfer GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def monthly_series(t: Tables) -> DataFrame:
    return L.last_months(t.ledger(), 12)


_SPENT = f"SELECT category_id, sum(CASE WHEN amount < 0 AND NOT is_refund THEN amount END) AS gross, sum(CASE WHEN is_refund THEN amount END) AS back, count(id) AS n FROM ledger WHERE NOT internal_transfer AND {IN_PERIOD} GROUP BY 1"
_BUDGETED = f"SELECT category_id, name, priority, CAST(monthly_limit AS DECIMAL(18,2)) AS monthly_limit, {m('gross')} AS spent_gross, {m('back')} AS refunded, coalesce(n, 0) AS n, warning, critical FROM budgets LEFT JOIN spent USING (category_id) WHERE is_active"
_USED = "SELECT *, CAST(spent_gross + refunded AS DECIMAL(18,2)) AS net, coalesce(CAST(abs(spent_gross + refunded) AS DOUBLE) / nullif(CAST(monthly_limit AS DOUBLE), 0), 0.0) AS u FROM b"
_STATUS = "SELECT category_id, name, priority, monthly_limit, spent_gross, refunded, net, CAST(monthly_limit + net AS DECIMAL(18,2)) AS remaining, round(u, 4) AS utilisation, CASE WHEN u >= critical THEN 'critical' WHEN u >= warning THEN 'warning' ELSE 'ok' END AS status, n FROM used"
_BUDGETS = dict(spent=_SPENT, b=_BUDGETED, used=_USED, spending=_STATUS)


@query(with_("ledger", "budgets", **_BUDGETS) + "SELECT * FROM spending")
def budget_spending(t: Tables) -> DataFrame:
    return L.budget_spending(L.between(t.ledger(), START, END), t.budgets()).orderBy(F.desc("priority"), "name")


@query(with_("ledger", "budgets", **_BUDGETS) + "SELECT * FROM spending WHERE status IN ('warning', 'critical') OR remaining < 0")
def budget_risks(t: Tables) -> DataFrame:
    return L.budget_risks(L.budget_spending(L.between(t.ledger(), START, END), t.budgets()))


@query(with_("ledger", "categories", s=f"SELECT coalesce(name, 'Unkategorisiert') AS name, {m('sum(amount)')} AS total FROM ledger LEFT JOIN categories USING (category_id) WHERE NOT internal_transfer AND {IN_PERIOD} GROUP BY 1")
       + f"SELECT name, total, CASE WHEN total < 0 THEN {r('-total * 100', '(SELECT sum(-total) FROM s WHERE total < 0)', 1)} ELSE 0.0 END AS share_pct FROM s")
def category_breakdown(t: Tables) -> DataFrame:
    return L.breakdown(L.between(t.ledger(), START, END), t.categories())


_TX = "id, booking_date, CAST(amount AS DECIMAL(18,2)) AS amount"


def _tx(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "booking_date", money(F.col("amount")).alias("amount"), *more)


@query(with_("ledger") + f"SELECT {_TX}, source FROM ledger WHERE {IN_PERIOD} AND source = 'card' AND NOT internal_transfer ORDER BY booking_date DESC, id LIMIT 50 OFFSET 50")
def transaction_page(t: Tables) -> DataFrame:
    return L.page(_tx(L.selected(t.ledger(), START, END, source="card", internal_transfer=False), "source"), F.desc("booking_date"), F.col("id"), limit=50, offset=50)


@query(with_("ledger", "tags") + f"SELECT {_TX} FROM ledger WHERE EXISTS (SELECT 1 FROM tags WHERE tags.id = ledger.id AND tag IN ('five', 'seven'))")
def transactions_with_tag(t: Tables) -> DataFrame:
    return _tx(L.selected(t.ledger(), tags=(t.tags(), ["five", "seven"])))


@query(with_("ledger") + f"SELECT {_TX} FROM ledger WHERE contains(lower(coalesce(recipient, '')), '#00000001') OR contains(lower(coalesce(sender, '')), '#00000001') OR contains(lower(coalesce(description, '')), '#00000001')")
def transaction_search(t: Tables) -> DataFrame:
    return _tx(L.selected(t.ledger(), text="#00000001"))


@query(with_("ledger", "tags", g="SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY id")
       + "SELECT id, booking_date, valuation_date, description, coalesce(nullif(recipient, ''), nullif(sender, ''), '') AS counterparty, CAST(amount AS VARCHAR) AS amount, coalesce(category_id, '') AS category, coalesce(tags, '') AS tags FROM (SELECT * FROM ledger ORDER BY booking_date DESC, id LIMIT 50000) LEFT JOIN g USING (id)")
def transaction_export(t: Tables) -> DataFrame:
    return L.export(t.ledger(), t.tags())


@query(with_("ledger") + "SELECT source, count(*) AS n FROM ledger WHERE category_id IS NULL AND NOT internal_transfer GROUP BY 1")
def uncategorised_by_source(t: Tables) -> DataFrame:
    return L.uncategorised(t.ledger()).groupBy("source").agg(F.count("*").alias("n"))


@query(with_("ledger") + f"SELECT recipient, min(booking_date) AS first_seen FROM ledger WHERE recipient IS NOT NULL GROUP BY 1 HAVING min(booking_date) >= DATE '{START}'")
def new_counterparties(t: Tables) -> DataFrame:
    return L.new_counterparties(t.ledger(), START)


@query(with_("ledger", "categories") + f"SELECT {_TX}, coalesce(name, 'Unkategorisiert') AS category FROM ledger LEFT JOIN categories USING (category_id) WHERE {IN_PERIOD}")
def period_transactions(t: Tables) -> DataFrame:
    rows = L.between(t.ledger(), START, END).join(t.categories(), "category_id", "left")
    return _tx(rows.withColumn("category", F.coalesce("name", F.lit(L.UNCATEGORISED))), "category").orderBy("booking_date", "id")


@query(with_("ledger", "categories") + f"SELECT {_TX}, name FROM ledger LEFT JOIN categories USING (category_id) WHERE is_outlier AND {IN_PERIOD}")
def outliers_in_period(t: Tables) -> DataFrame:
    return _tx(L.between(t.ledger(), START, END).where("is_outlier").join(t.categories(), "category_id", "left"), "name")


@query(with_("ledger") + f"SELECT {_TX} FROM ledger WHERE amount < 0 AND NOT internal_transfer AND {IN_PERIOD} ORDER BY amount, id LIMIT 20")
def top_debits(t: Tables) -> DataFrame:
    return _tx(L.between(t.ledger(), START, END).where("amount < 0 and not internal_transfer")).orderBy("amount", "id").limit(20)


@query(with_("ledger") + f"SELECT {_TX} FROM ledger ORDER BY abs(amount) DESC, booking_date, id LIMIT 10")
def largest_transactions(t: Tables) -> DataFrame:
    return _tx(t.ledger()).orderBy(F.desc(F.abs("amount")), "booking_date", "id").limit(10)


@query(with_("ledger") + f"SELECT source, {m('sum(CASE WHEN amount > 0 THEN amount END)')} AS total_in, {m('sum(CASE WHEN amount < 0 THEN amount END)')} AS total_out, count(*) AS n, {m('sum(amount)')} AS net FROM ledger GROUP BY ROLLUP (source)")
def account_totals(t: Tables) -> DataFrame:
    return L.account_totals(t.ledger())


@query(with_("ledger") + f"SELECT coalesce(nullif(trim(recipient), ''), 'Unbekannt') AS counterpart, {m('sum(amount)')} AS total, count(*) AS n FROM ledger WHERE amount < 0 GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def top_counterparts(t: Tables) -> DataFrame:
    return L.top_counterparts(t.ledger())


@query(with_("ledger") + f"SELECT recipient AS counterpart, count(*) AS n, {m('sum(amount)')} AS total FROM ledger WHERE amount < 0 AND recipient IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10")
def frequent_counterparts(t: Tables) -> DataFrame:
    return L.frequent_counterparts(t.ledger())


@query(with_("ledger") + f"SELECT {_TX} FROM ledger WHERE booking_date IS NULL OR booking_date >= DATE '{START}'")
def export_since(t: Tables) -> DataFrame:
    return _tx(t.ledger().where(F.col("booking_date").isNull() | (F.col("booking_date") >= F.to_date(F.lit(START)))))


_PARENT = "SELECT id, CAST(okey - okey % 2 AS VARCHAR) AS parent FROM ledger WHERE okey % 2 = 1"


@query(with_("ledger", edges=_PARENT) + "SELECT e.id AS id, 'parent' AS direction, e.parent AS related FROM edges e JOIN ledger p ON p.id = e.parent UNION ALL SELECT e.parent AS id, 'child' AS direction, e.id AS related FROM edges e JOIN ledger p ON p.id = e.parent")
def links_both_ways(t: Tables) -> DataFrame:
    rows = t.ledger()
    edges = rows.where("okey % 2 = 1").select("id", (F.col("okey") - 1).cast("string").alias("parent")).join(rows.select(F.col("id").alias("parent")), "parent", "left_semi")
    return edges.select(F.explode(F.array(F.struct("id", F.lit("parent").alias("direction"), F.col("parent").alias("related")), F.struct(F.col("parent").alias("id"), F.lit("child").alias("direction"), F.col("id").alias("related")))).alias("e")).select("e.*")


@query(with_("ledger") + f"SELECT {_TX} FROM ledger WHERE category_id IS NULL AND NOT internal_transfer ORDER BY booking_date DESC, id LIMIT 200")
def uncategorised_newest(t: Tables) -> DataFrame:
    return _tx(L.uncategorised(t.ledger())).orderBy(F.desc("booking_date"), "id").limit(200)


@query(with_("ledger") + "SELECT date_trunc('month', booking_date)::DATE AS cycle, CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) AS net_cents, min(booking_date) AS first, max(booking_date) AS last, count(*) AS n FROM ledger WHERE source = 'card' GROUP BY 1")
def card_cycles(t: Tables) -> DataFrame:
    from tallyhouse.operators.pairing import card_cycles as cycles

    return cycles(t.ledger().where("source = 'card'"))


@query(with_("ledger", s="SELECT category_id, sum(amount) AS total FROM ledger GROUP BY 1") + "SELECT count(*) AS transactions, count(DISTINCT source) AS sources, count(DISTINCT category_id) AS categories, CAST(count_if(category_id IS NULL) AS BIGINT) AS uncategorised, min(booking_date) AS first, max(booking_date) AS last FROM ledger")
def export_counts(t: Tables) -> DataFrame:
    return t.ledger().agg(F.count("*").alias("transactions"), F.countDistinct("source").alias("sources"), F.countDistinct("category_id").alias("categories"), F.count_if(F.col("category_id").isNull()).alias("uncategorised"), F.min("booking_date").alias("first"), F.max("booking_date").alias("last"))


@query(with_("ledger", "categories") + f"SELECT 'summary' AS part, count(*) AS n, {m('sum(amount)')} AS total FROM ledger WHERE NOT internal_transfer AND {IN_PERIOD} UNION ALL SELECT 'uncategorised', count(*), {m('sum(amount)')} FROM ledger WHERE category_id IS NULL AND NOT internal_transfer AND {IN_PERIOD} UNION ALL SELECT 'outliers', count(*), {m('sum(amount)')} FROM ledger WHERE is_outlier AND {IN_PERIOD} UNION ALL SELECT 'refunds', count(*), {m('sum(amount)')} FROM ledger WHERE is_refund AND {IN_PERIOD}")
def analysis_context(t: Tables) -> DataFrame:
    """All parts of a period's context in one pass: a row counts for each part that it belongs to."""
    rows = L.between(t.ledger(), START, END)
    parts = F.array_compact(F.array(F.when(~F.col("internal_transfer"), "summary"), F.when(F.col("category_id").isNull() & ~F.col("internal_transfer"), "uncategorised"), F.when(F.col("is_outlier"), "outliers"), F.when(F.col("is_refund"), "refunds")))
    return rows.select(F.explode(parts).alias("part"), "amount").groupBy("part").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


@query(with_("ledger") + f"SELECT id, abs(CAST(amount * 100 AS BIGINT)) AS cents, {r('amount', '3')} AS third FROM ledger")
def cents_and_ratio(t: Tables) -> DataFrame:
    return t.ledger().select("id", F.abs(cents(F.col("amount"))).alias("cents"), ratio(F.col("amount"), F.lit(3)).alias("third"))
