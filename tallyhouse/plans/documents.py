"""Whole documents: the agent's input, exports and the report, each as the pieces of text that it is written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import documents as D
from tallyhouse.plans.registry import query
from tallyhouse.plans.reporting import START, m, r
from tallyhouse.sources.tables import Tables, with_

_ACCOUNTS = [("bank", "Giro"), ("wallet", "CA"), ("card", "Credit Card"), ("none", None)]
_AT, _DAY = "1998-12-31T00:00:00+00:00", "1998-12-31"


def _accounts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_ACCOUNTS, "account_id string, account_type string")


def _bookings(t: Tables) -> DataFrame:
    debit, iban = F.col("amount") < 0, F.concat(F.lit("DE"), F.col("custkey").cast("string"))
    return t.ledger().select(
        F.col("source").alias("account_id"), "id", "booking_date", "valuation_date", F.col("category_id").alias("type_text"), "description", "amount", F.lit("EUR").alias("currency"), F.col("recipient").alias("creditor_name"), F.when(debit, iban).alias("creditor_iban"), F.col("sender").alias("debtor_name"), F.when(~debit, iban).alias("debtor_iban"))


def _trades(t: Tables) -> DataFrame:
    return t.trades().withColumn("id", F.concat_ws("-", F.col("okey").cast("string"), F.col("line").cast("string"))).drop("okey", "line")


def _j(x: str) -> str:
    """A text as JSON."""
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


def _o(**values: str) -> str:
    """An object of SQL expressions that are JSON already."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in values.items()) + " || '}'"


def _n(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'null')"


def _d(x: str) -> str:
    return _j(f"CAST({x} AS VARCHAR)")


def _members(section: int, group: str, text: str, of: str, keys: str, order: str) -> str:
    """A list's members in order, with a comma before all but the first of each group."""
    n = f"row_number() OVER (PARTITION BY {keys} ORDER BY {order}, {text})"
    return f"SELECT {section} AS section, 1 AS level, {group} AS \"group\", 1 AS part, {n} AS n, CASE WHEN {n} > 1 THEN ',' ELSE '' END || {text} AS text FROM {of}"


def _piece(section: int, level: int, group: str, part: int, text: str, of: str = "") -> str:
    return f"SELECT {section} AS section, {level} AS level, {group} AS \"group\", {part} AS part, 0 AS n, {text} AS text {of}"


_FIRST = "(SELECT min(n_nationkey) FROM nation)"
_MAPPED = dict(
    bk="SELECT id, source AS account_id, CASE source WHEN 'card' THEN 'credit_card' ELSE 'girokonto' END AS account, booking_date, valuation_date, category_id, description, CAST(amount AS DECIMAL(18,2)) AS amount, CASE WHEN amount < 0 THEN recipient ELSE sender END AS who, 'DE' || custkey AS iban FROM ledger",
    named="SELECT * FROM (VALUES ('girokonto', 'bank', 2), ('credit_card', 'card', 1), ('unknown', 'none', 1)) v(account, account_id, accounts)",
    sums=f"SELECT account, named.account_id, {m('sum(CASE WHEN amount > 0 THEN amount END)')} AS total_in, {m('sum(CASE WHEN amount < 0 THEN -amount END)')} AS total_out, {m('sum(amount)')} AS net, count(amount) AS n FROM named LEFT JOIN bk USING (account) GROUP BY 1, 2",
    held=f"SELECT isin, name, quantity, CAST(current_value AS DECIMAL(18,2)) AS cv, CAST(purchase_value AS DECIMAL(18,2)) AS pv, CAST(current_value - purchase_value AS DECIMAL(18,2)) AS gains, {r('(current_value - purchase_value) * 100', 'purchase_value')} AS pct FROM positions LEFT JOIN instruments USING (isin) WHERE depot_id = {_FIRST}",
    dealt=f"SELECT booking_date AS date, isin, name, transaction_type AS kind, quantity, CAST(amount AS DECIMAL(18,2)) AS amount, okey || '-' || line AS id FROM trades LEFT JOIN instruments USING (isin) WHERE depot_id = {_FIRST}",
    depot=f"SELECT {m('sum(cv)')} AS tv, {m('sum(pv)')} AS tp, CAST({m('sum(cv)')} - {m('sum(pv)')} AS DECIMAL(18,2)) AS tg, {r('(sum(cv) - sum(pv)) * 100', 'sum(pv)')} AS pct, count(*) AS n FROM held",
)
_BOOKING = _o(date=_d("booking_date"), booking_date=_d("booking_date"), value_date=_d("valuation_date"), type=_j("category_id"), text=_j("description"), amount=_n("amount"), currency="'\"EUR\"'", counterpart_name=_j("who"), counterpart_iban=_j("iban"), transaction_id=_j("id"))
_POSITION = _o(isin=_n("isin"), name=_j("name"), quantity=_n("quantity"), current_value=_n("cv"), purchase_value=_n("pv"), gains=_n("gains"), gains_percent=_n("pct"))
_TRADE = _o(date=_d("date"), isin=_n("isin"), name=_j("name"), transaction_type=_j("kind"), quantity=_n("quantity"), amount=_n("amount"), transaction_id=_j("id"))
_META = _o(exported_at=f"'\"{_AT}\"'", account_count="'4'", total_transaction_count="((SELECT count(*) FROM bk) + (SELECT count(*) FROM dealt))")
_ENTRY = f"',' || {_j('account')} || ':{{\"account_id\":' || {_j('account_id')} || ',\"summary\":' || {_o(total_in=_n('total_in'), total_out=_n('total_out'), net=_n('net'), count=_n('n'))} || ',\"transactions\":['"
_DEPOT = f"',\"depot\":{{\"depot_id\":\"' || {_FIRST} || '\",\"summary\":' || {_o(total_value=_n('tv'), total_purchase_value=_n('tp'), total_gains=_n('tg'), total_gains_percent=_n('pct'), position_count=_n('n'))}"


@query(with_("ledger", "positions", "instruments", "trades", **_MAPPED) + " UNION ALL ".join([
    _piece(0, 0, "''", 0, f"'{{\"meta\":' || {_META}"), _piece(1, 1, "account", 0, _ENTRY, "FROM sums"), _piece(1, 1, "account", 2, "']}'", "FROM sums"), _piece(2, 0, "''", 0, _DEPOT, "FROM depot"), *[_piece(2, 1, f"'{g}'", 0, f"',\"{g}\":['") for g in ("positions", "transactions")],
    *[_piece(2, 1, f"'{g}'", 2, "']'") for g in ("positions", "transactions")], _piece(2, 2, "''", 2, "'}}'"), _members(1, "account", _BOOKING, "bk", "account", "booking_date, id"), _members(2, "'positions'", _POSITION, "held", "1", "isin"), _members(2, "'transactions'", _TRADE, "dealt", "1", "date, id")]))
def agent_document(t: Tables) -> DataFrame:
    """The agent's input of all accounts and the first depot."""
    return D.agent_document(_bookings(t), _accounts(t), t.depots(), t.positions(), _trades(t), t.instruments(), _AT)


_LATE = f"(booking_date IS NULL OR booking_date >= DATE '{START}')"
_EXPORTED = dict(
    bk=f"SELECT *, CASE WHEN amount < 0 THEN 'DE' || custkey END AS ci, CASE WHEN amount >= 0 THEN 'DE' || custkey END AS di FROM ledger WHERE {_LATE}",
    tr=f"SELECT *, okey || '-' || line AS id FROM trades WHERE {_LATE}",
    acc="SELECT * FROM (VALUES ('bank', 'Giro'), ('wallet', 'CA'), ('card', 'Credit Card'), ('none', NULL)) v(id, kind)",
    lists="SELECT DISTINCT 3 AS section, source AS g FROM bk UNION SELECT 4, CAST(depot_id AS VARCHAR) FROM positions UNION SELECT 5, CAST(depot_id AS VARCHAR) FROM tr",
)
_COUNTS = _o(format="'\"tallyhouse-export\"'", format_version="'\"1.0\"'", exported_at=f"'\"{_AT}\"'", account_count="'4'", transaction_count="(SELECT count(*) FROM bk)", depot_count="(SELECT count(*) FROM depots)", position_count="(SELECT count(*) FROM positions)", depot_transaction_count="(SELECT count(*) FROM tr)", since=f"'\"{START}\"'")
_RAW = _o(id=_j("id"), booking_date=_d("booking_date"), valuation_date=_d("valuation_date"), type_text=_j("category_id"), description=_j("description"), amount=_n("amount"), currency="'\"EUR\"'", creditor_name=_j("recipient"), creditor_iban=_j("ci"), debtor_name=_j("sender"), debtor_iban=_j("di"))
_HELD = _o(isin=_n("isin"), quantity=_n("quantity"), current_value=_n("current_value"), purchase_value=_n("purchase_value"))
_TRADED = _o(isin=_n("isin"), booking_date=_d("booking_date"), transaction_type=_j("transaction_type"), amount=_n("amount"), id=_j("id"))
_NAMES = {3: "transactions", 4: "depot_positions", 5: "depot_transactions"}


@query(with_("ledger", "positions", "trades", "depots", **_EXPORTED) + " UNION ALL ".join([
    _piece(0, 0, "''", 0, f"'{{\"meta\":' || {_COUNTS}"), *[_piece(s, 1, "''", p, x) for s, n in ((1, "accounts"), (2, "depots")) for p, x in ((0, f"',\"{n}\":['"), (2, "']'"))], *[_piece(s, k, "''", k, x) for s, n in _NAMES.items() for k, x in ((0, f"',\"{n}\":{{'"), (2, "'}'"))],
    _piece(0, 1, "g", 0, f"CASE WHEN g = min(g) OVER (PARTITION BY section) THEN '' ELSE ',' END || {_j('g')} || ':['", "FROM lists").replace("SELECT 0 AS section", "SELECT section"), _piece(0, 1, "g", 2, "']'", "FROM lists").replace("SELECT 0 AS section", "SELECT section"), _piece(9, 2, "''", 2, "'}'"),
    _members(1, "''", _o(account_id=_j("id"), account_type=_j("kind")), "acc", "1", "id"), _members(2, "''", _o(depot_id=_n("depot_id"), name=_j("name")), "depots", "1", "CAST(depot_id AS VARCHAR)"), _members(3, "source", _RAW, "bk", "source", "booking_date, id"),
    _members(4, "CAST(depot_id AS VARCHAR)", _HELD, "positions", "depot_id", "isin"), _members(5, "CAST(depot_id AS VARCHAR)", _TRADED, "tr", "depot_id", "booking_date, id")]))
def export_document(t: Tables) -> DataFrame:
    """All accounts and depots since a day."""
    positions = t.positions().select("depot_id", "isin", "quantity", "current_value", "purchase_value")
    trades = _trades(t).select("depot_id", "isin", "booking_date", "transaction_type", "amount", "id")
    return D.export_document(_bookings(t), _accounts(t), t.depots(), positions, trades, _AT, START)


def _eur(x: str) -> str:
    return f"replace(replace(replace(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' EUR'"


def _pct(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '-' END || replace(CAST(CAST(round(abs(CAST({x} AS DECIMAL(18,4))), 2) AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' %'"


def _cells(*x: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(x) + " || ' |'"


_QUANTITY = "CASE WHEN quantity = floor(quantity) THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST(quantity AS DECIMAL(28,6)) AS VARCHAR), '0') END"


def _top(section: int, of: str, order: str, text: str, most: str = "LIMIT 10") -> str:
    return f"SELECT * FROM (SELECT {section} AS section, 1 AS part, row_number() OVER (ORDER BY {order}, {text}) AS n, {text} AS text FROM {of} ORDER BY n {most})"


_SHORT = "coalesce(nullif(description, ''), category_id, '—')"
_BODY = " UNION ALL ".join([
    _top(1, "sums", "account", _cells("CASE account WHEN 'credit_card' THEN 'Credit Card' WHEN 'girokonto' THEN 'Girokonto' ELSE 'Unknown' END", _eur("total_in"), _eur("total_out"), _eur("net"), "n"), ""),
    f"SELECT 1, 2, 0, {_cells(repr(D.REPORT_TOTAL), *[f"'**' || {_eur(f'sum({c})')} || '**'" for c in ('total_in', 'total_out', 'net')], "'**' || CAST(sum(n) AS BIGINT) || '**'")} FROM sums",
    _top(2, "(SELECT coalesce(who, 'Unbekannt') AS name, sum(-amount) AS spent, count(*) AS c FROM bk WHERE amount < 0 GROUP BY 1)", "spent DESC, name", _cells("name", _eur("spent"), "c || 'x'")),
    _top(3, "bk", "abs(amount) DESC, id", _cells("booking_date", _eur("amount"), "coalesce(who, '—')", f"CASE WHEN length({_SHORT}) > 50 THEN left({_SHORT}, 47) || '...' ELSE {_SHORT} END")),
    _top(4, "(SELECT who AS name, count(*) AS c FROM bk WHERE who IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)", "c DESC, name", _cells("name", "c || 'x'")),
    _top(5, "held", "cv DESC, isin", _cells("coalesce(name, '?')", "isin", _QUANTITY, _eur("cv"), f"{_eur('gains')} || ' (' || {_pct('pct')} || ')'"), ""),
    f"SELECT 5, 2, 0, '| {D.REPORT_TOTAL} | | | **' || {_eur('tv')} || '** | **' || {_eur('tg')} || ' (' || {_pct('pct')} || ')** |' FROM depot WHERE n > 0",
    _top(6, "dealt", "date DESC, id", _cells("date", "kind", "coalesce(name, '?')", _QUANTITY, _eur("amount"))),
])
_HEADS = "SELECT * FROM (VALUES " + ", ".join(f"({s}, 0, {n}, '{x}')" for s, v in D.REPORT_HEADS.items() for n, x in enumerate(("", v[0], "", *v[1:]))) + ") v(section, part, n, text) WHERE section IN (SELECT section FROM body)"
_ENDS = "SELECT * FROM (VALUES " + ", ".join(f"({s}, 0, {n}, '{x}')" for s, n, x in ((0, 0, D.REPORT_TITLE + _DAY), (0, 1, ""), (0, 2, f"{D.REPORT_STATE}{_AT}*"), (9, 0, ""), (9, 1, "---"), (9, 2, f"*Generiert am {_DAY}*"))) + ") v(section, part, n, text)"


@query(with_("ledger", "positions", "instruments", "trades", **_MAPPED, body=_BODY) + f"SELECT * FROM body UNION ALL {_HEADS} UNION ALL {_ENDS}")
def full_report(t: Tables) -> DataFrame:
    """The lines of the report of everything."""
    return D.report(_bookings(t), _accounts(t), t.depots(), t.positions(), _trades(t), t.instruments(), _DAY, _AT)
