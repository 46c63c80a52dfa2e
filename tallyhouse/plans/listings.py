"""Listings, exports and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text as T
from tallyhouse.functions.numbers import even_ratio, money, month_later, relative_start
from tallyhouse.operators import ledger as L
from tallyhouse.operators import listings as P
from tallyhouse.operators import reports as R
from tallyhouse.plans.registry import query
from tallyhouse.plans.reporting import END, IN_PERIOD, INCOME, EXPENSE, START, m, r
from tallyhouse.sources.tables import Tables, with_

_RUNS = "SELECT event_id AS run_id, event_type AS agent, CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'completed' END AS status, ts AS started_at, CAST(ts AS DATE) AS day FROM events"


def _runs(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr("event_id AS run_id", "event_type AS agent", "CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'completed' END AS status", "ts AS started_at", "CAST(ts AS DATE) AS day")


@query(with_("ledger") + f"SELECT count(*) AS n FROM ledger WHERE {IN_PERIOD} AND source = 'card' AND NOT internal_transfer")
def transaction_count(t: Tables) -> DataFrame:
    return L.selected(t.ledger(), START, END, source="card", internal_transfer=False).agg(F.count("*").alias("n"))


@query(with_("ledger") + "SELECT id, CAST(amount AS DECIMAL(18,2)) AS amount FROM ledger WHERE category_id = '5-LOW' AND amount > 0")
def refund_report(t: Tables) -> DataFrame:
    """All credits of a category, whatever was decided about them."""
    return t.ledger().where("category_id = '5-LOW' and amount > 0").select("id", money(F.col("amount")).alias("amount"))


@query(with_("trades") + "SELECT okey, line, booking_date, CAST(amount AS DECIMAL(18,2)) AS amount FROM trades WHERE depot_id = 3 ORDER BY booking_date DESC, okey, line LIMIT 100 OFFSET 20")
def depot_page(t: Tables) -> DataFrame:
    return P.listed(t.trades(), F.desc("booking_date"), F.col("okey"), F.col("line"), limit=100, offset=20, depot_id=3).select("okey", "line", "booking_date", money(F.col("amount")).alias("amount"))


@query(f"WITH r AS ({_RUNS}) SELECT run_id, agent, status FROM r WHERE agent = 'click' AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 50")
def runs_list(t: Tables) -> DataFrame:
    return P.listed(_runs(t), F.desc("started_at"), F.col("run_id"), limit=50, agent="click", status="completed").select("run_id", "agent", "status")


@query(f"WITH r AS ({_RUNS}) SELECT run_id, agent, day FROM r WHERE agent = 'view' ORDER BY day DESC, started_at DESC, run_id LIMIT 30 OFFSET 5")
def reports_list(t: Tables) -> DataFrame:
    return P.listed(_runs(t), F.desc("day"), F.desc("started_at"), F.col("run_id"), limit=30, offset=5, agent="view").select("run_id", "agent", "day")


@query(f"WITH r AS ({_RUNS}) SELECT run_id, status FROM r WHERE status = 'failed' ORDER BY started_at DESC, run_id LIMIT 20")
def sync_runs_list(t: Tables) -> DataFrame:
    """The filter counts before the limit."""
    return P.listed(_runs(t), F.desc("started_at"), F.col("run_id"), limit=20, status="failed", agent=None).select("run_id", "status")


_OPEN = "CASE okey % 50 WHEN 0 THEN 'offen' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(booking_date AS STRING) END"


@query(with_("ledger", o=f"SELECT id, {_OPEN} AS booked FROM ledger") + f"SELECT id, booked FROM o WHERE booked IS NULL OR booked IN ('', 'offen') OR booked >= '{START}'")
def open_bookings(t: Tables) -> DataFrame:
    return P.open_or_since(t.ledger().selectExpr("id", f"{_OPEN} AS booked"), START, "booked")


@query(with_("positions") + "SELECT depot_id, isin, CAST(current_value AS DECIMAL(18,2)) AS value FROM positions WHERE depot_id = 4 ORDER BY current_value DESC, isin LIMIT 200")
def positions_by_value(t: Tables) -> DataFrame:
    return P.listed(t.positions(), F.desc("current_value"), F.col("isin"), limit=200, depot_id=4).select("depot_id", "isin", money(F.col("current_value")).alias("value"))


@query(with_("trades") + "SELECT okey, line, booking_date, transaction_type FROM trades ORDER BY booking_date DESC, okey, line LIMIT 10")
def latest_trades(t: Tables) -> DataFrame:
    return P.listed(t.trades(), F.desc("booking_date"), F.col("okey"), F.col("line"), limit=10).select("okey", "line", "booking_date", "transaction_type")


@query(f"WITH r AS ({_RUNS}) SELECT run_id, day FROM r WHERE agent = 'purchase' ORDER BY started_at DESC, run_id LIMIT 2")
def recent_reports(t: Tables) -> DataFrame:
    return P.latest(_runs(t), "started_at", 2, agent="purchase").select("run_id", "day")


@query(f"WITH r AS ({_RUNS}) SELECT run_id, agent FROM r WHERE agent = 'click' AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 1")
def latest_categorisation(t: Tables) -> DataFrame:
    return P.latest(_runs(t), "started_at", agent="click", status="completed").select("run_id", "agent")


@query(with_("depots", "trades", p="SELECT depot_id, sum(amount) AS v, max(booking_date) AS as_of, count(*) AS n FROM trades GROUP BY 1") + f"SELECT depot_id, {m('v')} AS value, as_of, coalesce(n, 0) AS n FROM depots LEFT JOIN p USING (depot_id)")
def depot_dates(t: Tables) -> DataFrame:
    """Value, count and latest date of each depot, empty ones included."""
    sums = t.trades().groupBy("depot_id").agg(F.sum("amount").alias("v"), F.max("booking_date").alias("as_of"), F.count("*").alias("n"))
    return t.depots().join(sums, "depot_id", "left").select("depot_id", money(F.coalesce("v", F.lit(0))).alias("value"), "as_of", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(with_("ledger") + "SELECT date_trunc('month', booking_date)::DATE AS cycle, CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) AS net_cents, md5(string_agg(id, ',' ORDER BY id)) AS children FROM ledger WHERE source = 'card' GROUP BY 1")
def card_cycle_children(t: Tables) -> DataFrame:
    """The rows of each month of a card, as a digest of their ids in order."""
    from tallyhouse.operators.pairing import card_cycles

    rows = t.ledger().where("source = 'card'")
    kept = rows.groupBy(F.trunc("booking_date", "MM").alias("cycle")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("children"))
    return card_cycles(rows).join(kept, "cycle").select("cycle", "net_cents", "children")


@query(with_("positions", "instruments", x=f"SELECT isin, name, {m('current_value')} AS value, {m('purchase_value')} AS purchase FROM positions LEFT JOIN instruments USING (isin)", y=f"SELECT * FROM x UNION ALL SELECT NULL, 'GESAMT', {m('sum(value)')}, {m('sum(purchase)')} FROM x")
       + f"SELECT isin, name, value, purchase, CAST(value - purchase AS DECIMAL(18,2)) AS gain, {r('(value - purchase) * 100', 'purchase', 2)} + 0.0 AS gain_pct FROM y")
def positions_export(t: Tables) -> DataFrame:
    return R.positions_with_total(t.positions(), t.instruments()).drop("quantity")


@query(with_("trades", "instruments") + "SELECT booking_date, isin, name, transaction_type AS kind, quantity, CAST(amount AS DECIMAL(18,2)) AS amount FROM trades LEFT JOIN instruments USING (isin) WHERE depot_id = 5")
def trades_export(t: Tables) -> DataFrame:
    german = F.when(F.col("transaction_type") == "BUY", "Kauf").when(F.col("transaction_type") == "SELL", "verkauf").otherwise(F.col("transaction_type"))
    return R.trades_for_export(t.trades().where("depot_id = 5").withColumn("transaction_type", german), t.instruments())


@query(with_("ledger", "positions", a="SELECT source AS label, sum(amount) AS b FROM ledger GROUP BY 1", x=f"SELECT 'Konto' AS kind, label, {m('b')} AS balance FROM a UNION ALL SELECT 'Depot', 'Wertpapierdepot', {m('sum(current_value)')} FROM positions") + f"SELECT * FROM x UNION ALL SELECT 'GESAMT', '', {m('sum(balance)')} FROM x")
def wealth_export(t: Tables) -> DataFrame:
    return R.wealth(t.ledger().groupBy(F.col("source").alias("label")).agg(F.sum("amount").alias("balance")), t.positions())


_ACCOUNTS = [("bank", "Giro"), ("wallet", "CA"), ("card", "Credit Card"), ("none", None)]


@query(with_("ledger", x="SELECT CASE source WHEN 'card' THEN 'credit_card' ELSE 'girokonto' END AS account, amount FROM ledger UNION ALL SELECT 'unknown', NULL") + f"SELECT account, {m('sum(CASE WHEN amount > 0 THEN amount END)')} AS total_in, {m('sum(CASE WHEN amount < 0 THEN -amount END)')} AS total_out, count(amount) AS n, {m('sum(amount)')} AS net FROM x GROUP BY 1")
def agent_summary(t: Tables) -> DataFrame:
    accounts = t.spark.createDataFrame(_ACCOUNTS, "account_id string, account_type string")
    return R.for_agent(t.ledger().select(F.col("source").alias("account_id"), "amount"), accounts)


@query(with_("positions", s=f"SELECT (SELECT CAST(min(n_nationkey) AS BIGINT) FROM nation) AS depot_id, {m('sum(current_value)')} AS total_value, {m('sum(purchase_value)')} AS total_purchase_value, count(*) AS position_count FROM positions WHERE depot_id = (SELECT min(n_nationkey) FROM nation)")
       + f"SELECT *, CAST(total_value - total_purchase_value AS DECIMAL(18,2)) AS total_gains, {r('(total_value - total_purchase_value) * 100', 'total_purchase_value')} AS total_gains_percent FROM s")
def agent_depot(t: Tables) -> DataFrame:
    return R.first_depot(t.depots(), t.positions())


@query(with_("ledger") + "SELECT id, CASE WHEN amount < 0 THEN recipient ELSE sender END AS counterpart FROM ledger")
def agent_counterparts(t: Tables) -> DataFrame:
    return t.ledger().select("id", R.counterpart(F.col("amount"), F.col("recipient"), F.col("sender")).alias("counterpart"))


_SUM = f"SELECT {m(INCOME)} AS income, {m(EXPENSE)} AS expenses FROM ledger WHERE NOT internal_transfer AND {IN_PERIOD}"
_UNCATEGORISED = f"SELECT count(*) FROM ledger WHERE category_id IS NULL AND NOT internal_transfer AND {IN_PERIOD}"
_BY_NAME = f"SELECT name, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM ledger JOIN categories USING (category_id) WHERE NOT internal_transfer AND {IN_PERIOD} GROUP BY 1"
_TOP = f"SELECT id, amount FROM ledger WHERE amount < 0 AND NOT internal_transfer AND {IN_PERIOD} ORDER BY amount, id LIMIT 20"


def _context(t: Tables) -> dict[str, DataFrame]:
    """The parts of a period's analysis context, each a table with text columns."""
    rows, s = L.between(t.ledger(), START, END), lambda c: F.col(c).cast("string")
    summary = L.summary(rows)
    risks = L.budget_risks(L.budget_spending(rows, t.budgets()))
    return {
        "summary": summary.select(F.lit("").alias("key"), F.concat_ws("|", s("income"), s("expenses")).alias("value")),
        "risks": risks.select(F.col("category_id").alias("key"), F.col("status").alias("value")),
        "uncategorised": L.uncategorised(rows).agg(F.count("*").alias("n")).select(F.lit("").alias("key"), s("n").alias("value")),
        "semantics": t.categories().select(F.col("category_id").alias("key"), F.col("name").alias("value")),
        "categories": L.by_category(rows, t.categories()).select(F.col("name").alias("key"), s("total").alias("value")),
        "top": rows.where("amount < 0 and not internal_transfer").orderBy("amount", "id").limit(20).select(F.col("id").alias("key"), s("amount").alias("value")),
    }


def _parts(parts: dict[str, DataFrame]) -> DataFrame:
    found = R.bundle(**parts)
    return found.select("part", F.get_json_object("row", "$.key").alias("key"), F.get_json_object("row", "$.value").alias("value"))


_CONTEXT = (
    f"SELECT 'summary' AS part, '' AS key, CAST(income AS VARCHAR) || '|' || CAST(expenses AS VARCHAR) AS value FROM ({_SUM}) UNION ALL SELECT 'uncategorised', '', CAST(({_UNCATEGORISED}) AS VARCHAR) UNION ALL SELECT 'semantics', category_id, name FROM categories"
    f" UNION ALL SELECT 'categories', name, CAST(total AS VARCHAR) FROM ({_BY_NAME}) UNION ALL SELECT 'top', id, CAST(amount AS VARCHAR) FROM ({_TOP}) UNION ALL SELECT 'risks', category_id, status FROM spending WHERE status IN ('warning', 'critical') OR remaining < 0"
)


def _with_budgets(*names: str, **more: str) -> str:
    from tallyhouse.plans.reporting import _BUDGETS

    return with_("ledger", "categories", "budgets", *names, **_BUDGETS, **more)


@query(_with_budgets() + _CONTEXT)
def analysis_bundle(t: Tables) -> DataFrame:
    """The whole analysis context of a period: summary, risks, count without a category, what categories mean, their totals, largest debits."""
    return _parts(_context(t))


_OUTLIERS = f"SELECT 'outliers', id, CAST(amount AS VARCHAR) FROM ledger WHERE is_outlier AND {IN_PERIOD}"
_NEW = f"SELECT 'new', recipient, CAST(min(booking_date) AS VARCHAR) FROM ledger WHERE recipient IS NOT NULL GROUP BY 2 HAVING min(booking_date) >= DATE '{START}'"


def _sample(n: int, part: str) -> str:
    return f"SELECT '{part}', id, CAST(amount AS VARCHAR) FROM (SELECT * FROM ledger WHERE {IN_PERIOD} ORDER BY booking_date, id LIMIT {n})"


def _transactions(t: Tables, n: int) -> DataFrame:
    return L.between(t.ledger(), START, END).orderBy("booking_date", "id").limit(n).select(F.col("id").alias("key"), F.col("amount").cast("string").alias("value"))


@query(_with_budgets() + f"{_sample(50, 'transactions')} AS t(part, key, value)".replace("SELECT 'transactions', id, CAST(amount AS VARCHAR)", "SELECT 'transactions' AS part, id AS key, CAST(amount AS VARCHAR) AS value").replace(" AS t(part, key, value)", "")
       + f" UNION ALL SELECT 'count', '', CAST(count(*) AS VARCHAR) FROM ledger WHERE {IN_PERIOD} UNION ALL SELECT 'breakdown', coalesce(name, 'Unkategorisiert'), CAST(CAST(sum(amount) AS DECIMAL(18,2)) AS VARCHAR) FROM ledger LEFT JOIN categories USING (category_id) WHERE NOT internal_transfer AND {IN_PERIOD} GROUP BY 2 UNION ALL " + _CONTEXT)
def weekly_bundle(t: Tables) -> DataFrame:
    """What a weekly analysis is given: 50 bookings and their number, the breakdown and the context."""
    rows = L.between(t.ledger(), START, END)
    return _parts({
        "transactions": _transactions(t, 50), "count": rows.agg(F.count("*").alias("n")).select(F.lit("").alias("key"), F.col("n").cast("string").alias("value")),
        "breakdown": L.breakdown(rows, t.categories()).select(F.col("name").alias("key"), F.col("total").cast("string").alias("value")), **_context(t),
    })


@query(_with_budgets(mo=f"SELECT strftime(booking_date, '%Y-%m') AS month, {m(INCOME)} AS income FROM ledger WHERE NOT internal_transfer GROUP BY 1 ORDER BY 1 DESC LIMIT 6") + "SELECT 'series' AS part, month AS key, CAST(income AS VARCHAR) AS value FROM mo UNION ALL " + _sample(100, "transactions") + " UNION ALL " + _CONTEXT)
def monthly_bundle(t: Tables) -> DataFrame:
    """What a monthly analysis is given: six months, 100 bookings, the context."""
    return _parts({"series": L.last_months(t.ledger(), 6).select(F.col("month").alias("key"), F.col("income").cast("string").alias("value")), "transactions": _transactions(t, 100), **_context(t)})


@query(_with_budgets() + _sample(30, "sample").replace("SELECT 'sample', id, CAST(amount AS VARCHAR)", "SELECT 'sample' AS part, id AS key, CAST(amount AS VARCHAR) AS value") + f" UNION ALL {_OUTLIERS} UNION ALL {_NEW} UNION ALL " + _CONTEXT)
def anomaly_bundle(t: Tables) -> DataFrame:
    """What a search for anomalies is given: outliers, new counterparties, 30 bookings, the context."""
    rows = L.between(t.ledger(), START, END)
    return _parts({
        "sample": _transactions(t, 30), "outliers": rows.where("is_outlier").select(F.col("id").alias("key"), F.col("amount").cast("string").alias("value")),
        "new": L.new_counterparties(t.ledger(), START).select(F.col("recipient").alias("key"), F.col("first_seen").cast("string").alias("value")), **_context(t),
    })


@query("WITH u AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://hooks.example/api/' || CAST(event_id * 1000003 AS VARCHAR) || '/' WHEN 1 THEN 'https://hooks.example/' || CAST(event_id % 100 AS VARCHAR) WHEN 2 THEN 'plain' END AS url FROM events) SELECT event_id, CASE WHEN url IS NULL OR NOT contains(url, '/') THEN url WHEN length(regexp_extract(rtrim(url, '/'), '[^/]*$')) <= 6 THEN regexp_replace(rtrim(url, '/'), '[^/]*$', '') || '…' ELSE regexp_replace(rtrim(url, '/'), '[^/]*$', '') || '…' || right(rtrim(url, '/'), 6) END AS masked FROM u")
def masked_urls(t: Tables) -> DataFrame:
    urls = t.raw("events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://hooks.example/api/"), (F.col("event_id") * 1000003).cast("string"), F.lit("/"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("https://hooks.example/"), (F.col("event_id") % 100).cast("string"))).when(F.col("event_id") % 4 == 2, "plain").alias("url"))
    return urls.select("event_id", T.masked_url(F.col("url")).alias("masked"))


@query(with_("ledger") + "SELECT id, CAST(booking_date + to_months(CAST(okey % 14 AS INTEGER)) AS DATE) AS later, DATE '1998-12-31' - CAST(okey % 4000 AS INTEGER) AS d, okey FROM ledger WHERE okey % 4000 <= 3650")
def shifted_dates(t: Tables) -> DataFrame:
    rows = t.ledger().withColumn("d", relative_start(F.concat(F.lit("-"), (F.col("okey") % 4000).cast("string"), F.lit("d")), F.to_date(F.lit("1998-12-31"))))
    return rows.where("d is not null").select("id", month_later(F.col("booking_date"), (F.col("okey") % 14).cast("int")).alias("later"), "d", "okey")


@query(with_("ledger", c="SELECT id, CAST(amount * 100 AS BIGINT) AS c FROM ledger", f="SELECT id, CAST(floor(c / 8.0) AS BIGINT) AS lo, c - 8 * CAST(floor(c / 8.0) AS BIGINT) AS rest FROM c") + "SELECT id, (CASE WHEN rest < 4 OR (rest = 4 AND lo % 2 = 0) THEN lo ELSE lo + 1 END) / 100.0 AS eighth FROM f")
def even_ratios(t: Tables) -> DataFrame:
    """Eighths of cents end in 5 often: ties go to the even digit."""
    return t.ledger().select("id", even_ratio(F.col("amount"), F.lit(8), 2).cast("double").alias("eighth"))


_KNOWN = ["id", "sender", "iban", "amount"]


@query("SELECT DISTINCT k FROM (SELECT event_type AS k FROM events UNION ALL SELECT unnest(['id', 'sender', 'iban', 'amount', 'click']))")
def observed_keys(t: Tables) -> DataFrame:
    """Keys that were seen or are known, each once."""
    return t.raw("events").select(F.col("event_type").alias("k")).union(t.spark.createDataFrame([(k,) for k in [*_KNOWN, "click"]], "k string")).distinct()
