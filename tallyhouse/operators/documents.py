"""Whole documents as rows: exports and the agent's input in JSON, the report in Markdown. No task or driver holds a document: it is pieces of text in an order, written as files whose content is the document when read one after another.

Rows of a list come in the order of (booking_date, id), of positions by isin; those that tie come by their text, repeated rows stay. Null fields are written as null, accounts of a null type are "unknown", lists without rows are empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import money, ratio, total
from tallyhouse.functions.text import german_money, shortened
from tallyhouse.operators import reports as R
from tallyhouse.operators.ordering import numbered

#: What orders the pieces of a document.
PLACE = ["section", "level", "group", "part", "n"]
#: The report's headings and heads of tables.
REPORT_TITLE, REPORT_STATE, REPORT_TOTAL = "# Finanzreport — ", "*Datenstand: ", "**Gesamt**"
REPORT_HEADS = {
    1: ("## Kontenübersicht", "| Konto | Ein | Aus | Netto | Transaktionen |", "|-------|-----|-----|-------|---------------|"),
    2: ("## Top-Ausgaben nach Empfänger", "| Empfänger | Summe | Anzahl |", "|-----------|-------|--------|"),
    3: ("## Größte Einzelbuchungen", "| Datum | Betrag | Gegenpartei | Beschreibung |", "|-------|--------|-------------|--------------|"),
    4: ("## Wiederkehrende Gegenparteien (≥ 3 Buchungen)", "| Gegenpartei | Buchungen |", "|-------------|-----------|"),
    5: ("## Depot", "| Wertpapier | ISIN | Stück | Wert | Gewinn/Verlust |", "|------------|------|-------|------|----------------|"),
    6: ("## Depot-Transaktionen", "| Datum | Art | Wertpapier | Stück | Betrag |", "|-------|-----|------------|-------|--------|"),
}


def quoted(c: Column) -> Column:
    """A value as JSON."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _object(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _percent_number(a: Column, b: Column) -> Column:
    """``a`` in per cent of ``b`` (decimals), to four digits, as a JSON number that is written out (0.0005, not 5.0E-4) and keeps its sign where it rounds to zero."""
    digits = F.regexp_replace(F.abs(ratio(a * 100, b, 4)).cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.concat(F.when(((b > 0) & (a < 0)) | ((b < 0) & (a >= 0)), "-").otherwise(""), digits)


def _with_number(json: Column, name: str, number: Column) -> Column:
    """An object with one more field at its end, a number as text."""
    return F.concat(F.substring(json, F.lit(1), F.length(json) - 1), F.lit(f',"{name}":'), number, F.lit("}"))


def composed(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, level, group, part, n, text) of ``frames`` (section, level, group, part, text), which open (part 0) and close (part 2) lists, and ``rows`` (section, level, group, by, tie, text), their members in order: commas stand before all but a list's first."""
    members = numbered(rows, ["section", "level", "group"], ["by", "tie", "text"], "n")
    text = F.when(F.col("n") > 1, F.concat(F.lit(","), F.col("text"))).otherwise(F.col("text"))
    members = members.select("section", "level", "group", F.lit(1).alias("part"), "n", text.alias("text"))
    return frames.select("section", "level", "group", "part", F.lit(0).cast("bigint").alias("n"), "text").unionByName(members)


def write(document: DataFrame, path: str) -> None:
    """The pieces in their order, one a line, as text files of ranges: by name, one after another, they are the document."""
    document.orderBy(*[c for c in PLACE if c in document.columns]).select("text").write.text(path)


def _frame(one: DataFrame, section: int, level: int, group: str, part: int, text: Column) -> DataFrame:
    return one.select(F.lit(section).alias("section"), F.lit(level).alias("level"), F.lit(group).alias("group"), F.lit(part).alias("part"), text.alias("text"))


def _together(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def named_accounts(accounts: DataFrame) -> DataFrame:
    """``accounts`` (account_id, account_type) with the name under which a report has them."""
    return accounts.select("account_id", R.account_name(F.col("account_type")).alias("account"))


def mapped_bookings(bookings: DataFrame, accounts: DataFrame) -> DataFrame:
    """account and what a report shows of ``bookings`` (account_id, id, booking_date, valuation_date, type_text, description, amount, currency, creditor and debtor with their IBANs): of the two sides the other one. Bookings of an account that is not listed are left out."""
    other = lambda kind: R.counterpart(F.col("amount"), F.col(f"creditor_{kind}"), F.col(f"debtor_{kind}"))
    return bookings.join(named_accounts(accounts), "account_id").select(
        "account", F.col("booking_date").alias("date"), "booking_date", F.col("valuation_date").alias("value_date"), F.col("type_text").alias("type"), F.col("description").alias("text"), money(F.col("amount")).alias("amount"), "currency",
        other("name").alias("counterpart_name"), other("iban").alias("counterpart_iban"), F.col("id").alias("transaction_id"))


def account_summaries(bookings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Of each account's name: its first account_id, in, out (both without a sign), net and count; accounts of one name are one, an account without bookings stays, a booking without an amount is counted."""
    sums = R.for_agent(bookings.select("account_id", F.coalesce("amount", F.lit(0)).alias("amount")), accounts)
    first = named_accounts(accounts).groupBy("account").agg(F.min("account_id").alias("account_id"), F.count("*").alias("accounts"))
    return first.join(sums, "account").select("account", "account_id", "accounts", "total_in", "total_out", "net", F.col("n").alias("count"))


def _of_first_depot(depots: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(depots.agg(F.min("depot_id").alias("depot_id"))), "depot_id", "left_semi")  # one row


def mapped_positions(positions: DataFrame, instruments: DataFrame) -> DataFrame:
    gain = F.col("current_value") - F.col("purchase_value")
    named = positions.join(instruments.select("isin", "name"), "isin", "left")
    return named.select("depot_id", "isin", "name", "quantity", money(F.col("current_value")).alias("current_value"), money(F.col("purchase_value")).alias("purchase_value"), money(gain).alias("gains"), ratio(gain * 100, F.col("purchase_value"), 4).alias("gains_percent"))


def mapped_trades(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """A depot's bookings with their instrument's name; ``trades`` has an ``id``."""
    named = trades.join(instruments.select("isin", "name"), "isin", "left")
    return named.select("depot_id", F.col("booking_date").alias("date"), "isin", "name", "transaction_type", "quantity", money(F.col("amount")).alias("amount"), F.col("id").alias("transaction_id"))


def _lists(rows: DataFrame, section: int, group: Column, value: Column, order: Column, tie: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.lit(1).alias("level"), group.alias("group"), value.alias("text"), order.cast("string").alias("by"), tie.cast("string").alias("tie"))


def agent_document(bookings: DataFrame, accounts: DataFrame, depots: DataFrame, positions: DataFrame, trades: DataFrame, instruments: DataFrame, exported_at: str) -> DataFrame:
    """The agent's input: an object with meta, an entry for each account's name (account_id, summary, transactions) and the first depot (depot_id, summary, positions, transactions). Without a depot its id is "" and its lists are empty."""
    mapped, held, dealt = mapped_bookings(bookings, accounts), mapped_positions(_of_first_depot(depots, positions), instruments), mapped_trades(_of_first_depot(depots, trades), instruments)
    sums = account_summaries(bookings, accounts)
    one = sums.agg(F.coalesce(F.sum("accounts"), F.lit(0)).alias("account_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("booked")).join(dealt.agg(F.count("*").alias("traded")), F.lit(True))
    meta = one.select(F.lit(exported_at).alias("exported_at"), "account_count", (F.col("booked") + F.col("traded")).alias("total_transaction_count"))
    depot, once = R.first_depot(depots, positions), depots.sparkSession.range(1)
    gained = _percent_number(F.col("total_value") - F.col("total_purchase_value"), F.col("total_purchase_value"))
    depot_summary = _with_number(_object("total_value", "total_purchase_value", "total_gains"), "total_gains_percent", gained)
    depot_summary = _with_number(depot_summary, "position_count", F.col("position_count").cast("string"))
    opening = F.concat(F.lit(","), quoted(F.col("account")), F.lit(':{"account_id":'), quoted(F.col("account_id")), F.lit(',"summary":'), _object("total_in", "total_out", "net", "count"), F.lit(',"transactions":['))
    entries = sums.select(F.lit(1).alias("section"), F.lit(1).alias("level"), F.col("account").alias("group"), F.explode(F.array(F.struct(F.lit(0).alias("part"), opening.alias("text")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("text")))).alias("f")).select("section", "level", "group", "f.part", "f.text")
    frames = _together(
        _frame(meta, 0, 0, "", 0, F.concat(F.lit('{"meta":'), _object("exported_at", "account_count", "total_transaction_count"))), entries,
        _frame(depot, 2, 0, "", 0, F.concat(F.lit(',"depot":{"depot_id":'), quoted(F.coalesce(F.col("depot_id").cast("string"), F.lit(""))), F.lit(',"summary":'), depot_summary)),
        _frame(once, 2, 1, "positions", 0, F.lit(',"positions":[')), _frame(once, 2, 1, "positions", 2, F.lit("]")),
        _frame(once, 2, 1, "transactions", 0, F.lit(',"transactions":[')), _frame(once, 2, 1, "transactions", 2, F.lit("]")), _frame(once, 2, 2, "", 2, F.lit("}}")))
    position = _with_number(_object(*[c for c in held.columns if c not in ("depot_id", "gains_percent")]), "gains_percent", _percent_number(F.col("current_value") - F.col("purchase_value"), F.col("purchase_value")))
    rows = _together(
        _lists(mapped, 1, F.col("account"), _object(*[c for c in mapped.columns if c != "account"]), F.col("date"), F.col("transaction_id")),
        _lists(held, 2, F.lit("positions"), position, F.lpad(F.col("isin").cast("string"), 20, "0"), F.lit("")),
        _lists(dealt, 2, F.lit("transactions"), _object(*[c for c in dealt.columns if c != "depot_id"]), F.col("date"), F.col("transaction_id")))
    return composed(frames, rows)


def export_document(bookings: DataFrame, accounts: DataFrame, depots: DataFrame, positions: DataFrame, trades: DataFrame, exported_at: str, since: str | None = None) -> DataFrame:
    """The whole export: meta with counts, accounts and depots as lists, bookings by account, positions and trades by depot. With ``since`` bookings and trades before that day are left out, those without a day stay; an account or depot without rows has no list."""
    def late(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("booking_date").isNull() | (F.col("booking_date") >= F.to_date(F.lit(since)))) if since else rows

    booked, traded, once = late(bookings), late(trades), depots.sparkSession.range(1)
    counts = booked.agg(F.count("*").alias("transaction_count"))
    for rows, name in ((accounts, "account_count"), (depots, "depot_count"), (positions, "position_count"), (traded, "depot_transaction_count")):
        counts = counts.join(rows.agg(F.count("*").alias(name)), F.lit(True))
    meta = _object(F.lit("tallyhouse-export").alias("format"), F.lit("1.0").alias("format_version"), F.lit(exported_at).alias("exported_at"), "account_count", "transaction_count", "depot_count", "position_count", "depot_transaction_count", F.lit(since).cast("string").alias("since"))
    frames, lists = [_frame(counts, 0, 0, "", 0, F.concat(F.lit('{"meta":'), meta))], []
    for section, (name, rows) in enumerate((("accounts", accounts), ("depots", depots)), 1):
        key = F.col(rows.columns[0])
        frames += [_frame(once, section, 1, "", 0, F.lit(f',"{name}":[')), _frame(once, section, 1, "", 2, F.lit("]"))]
        lists.append(_lists(rows, section, F.lit(""), _object(*rows.columns), key, F.lit("")))
    for section, (name, rows, key, by, tie) in enumerate((("transactions", booked, "account_id", "booking_date", "id"), ("depot_positions", positions, "depot_id", "isin", "isin"), ("depot_transactions", traded, "depot_id", "booking_date", "id")), 3):
        group = F.coalesce(F.col(key).cast("string"), F.lit(""))
        keys = rows.groupBy(group.alias("group")).agg(F.lit(1).alias("_")).select("group")
        least = keys.agg(F.min("group").alias("least"))
        opening = F.concat(F.when(F.col("group") == F.col("least"), "").otherwise(","), quoted(F.col("group")), F.lit(":["))
        opened = keys.join(F.broadcast(least), F.lit(True)).select("group", F.explode(F.array(F.struct(F.lit(0).alias("part"), opening.alias("text")), F.struct(F.lit(2).alias("part"), F.lit("]").alias("text")))).alias("f"))  # one row
        frames += [_frame(once, section, 0, "", 0, F.lit(f',"{name}":{{')), opened.select(F.lit(section).alias("section"), F.lit(1).alias("level"), "group", "f.part", "f.text"), _frame(once, section, 2, "", 2, F.lit("}"))]
        order = F.lpad(F.col(by).cast("string"), 20, "0") if by == "isin" else F.col(by)
        lists.append(_lists(rows, section, group, _object(*[c for c in rows.columns if c != key]), order, F.col(tie)))
    frames.append(_frame(once, 9, 2, "", 2, F.lit("}")))
    return composed(_together(*frames), _together(*lists))


def _plain(quantity: Column) -> Column:
    """A number without zeros at its end."""
    text = quantity.cast("decimal(28,6)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def _percent(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise("-"), F.translate(F.format_string("%.2f", F.round(F.abs(c), 2)), ".", ","), F.lit(" %"))


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("—")) for c in cells]), F.lit(" |"))


def report(bookings: DataFrame, accounts: DataFrame, depots: DataFrame, positions: DataFrame, trades: DataFrame, instruments: DataFrame, day: str, exported_at: str, most: int = 10, least: int = 3) -> DataFrame:
    """(section, part, n, text): the lines of the report of everything. Accounts with the sum of all; who was paid most; largest bookings; who comes often; positions of the first depot, largest first, with their sum; its latest trades.

    ``most`` lines each, but all accounts and positions. A section without lines has no heading, except that of the accounts. Equal values come by name, equal bookings and trades by id. Quantities are written out, not shortened to six digits.
    """
    mapped, held, dealt = mapped_bookings(bookings, accounts), mapped_positions(_of_first_depot(depots, positions), instruments), mapped_trades(_of_first_depot(depots, trades), instruments)
    sums = account_summaries(bookings, accounts)
    euro = lambda c: german_money(F.col(c))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    lines = numbered(sums.select(F.lit(1).alias("k"), F.col("account"), _line(F.initcap(F.translate("account", "_", " ")), euro("total_in"), euro("total_out"), euro("net"), F.col("count").cast("string")).alias("text")), ["k"], ["account"], "n")
    one = sums.agg(*[total(F.col(c)).alias(c) for c in ("total_in", "total_out", "net")], F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    all_ = one.select(F.lit(1).alias("section"), F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("n"), _line(F.lit(REPORT_TOTAL), *[bold(euro(c)) for c in ("total_in", "total_out", "net")], bold(F.col("count").cast("string"))).alias("text"))

    def ranked(rows: DataFrame, section: int, *order: Column) -> DataFrame:
        """The first ``most`` lines of a section."""
        first = rows.select(F.struct(*order, F.col("text")).alias("o")).orderBy("o").limit(most).agg(F.array_sort(F.collect_list("o")).alias("all_"))
        return first.select(F.lit(section).alias("section"), F.posexplode(F.col("all_.text")).alias("at", "text")).select("section", F.lit(1).alias("part"), (F.col("at") + 1).cast("bigint").alias("n"), "text")

    who = F.coalesce(F.nullif("counterpart_name", F.lit("")), F.lit("Unbekannt"))
    spent = mapped.where("amount < 0").groupBy(who.alias("name")).agg(total(-F.col("amount")).alias("spent"), F.count("*").alias("n"))
    spent = ranked(spent.withColumn("text", _line(F.col("name"), euro("spent"), F.concat(F.col("n").cast("string"), F.lit("x")))), 2, (-F.col("spent")).alias("a"), F.col("name"))
    about = shortened(F.coalesce(F.nullif("text", F.lit("")), F.nullif("type", F.lit("")), F.lit("—")))
    shown = _line(F.coalesce(F.col("date").cast("string"), F.lit("?")), euro("amount"), F.nullif("counterpart_name", F.lit("")), about)
    largest = ranked(mapped.select((-F.abs("amount")).alias("a"), "transaction_id", shown.alias("text")).where("a is not null"), 3, F.col("a"), F.col("transaction_id"))
    often = mapped.where("counterpart_name <> ''").groupBy(F.col("counterpart_name").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = ranked(often.withColumn("text", _line(F.col("name"), F.concat(F.col("n").cast("string"), F.lit("x")))), 4, (-F.col("n")).alias("a"), F.col("name"))
    gain = lambda c, p: F.concat(euro(c), F.lit(" ("), _percent(F.col(p)), F.lit(")"))
    each = held.select(F.lit(5).alias("k"), (-F.coalesce("current_value", F.lit(0))).alias("a"), "isin", _line(F.coalesce("name", F.lit("?")), F.coalesce(F.col("isin").cast("string"), F.lit("?")), _plain(F.col("quantity")), euro("current_value"), gain("gains", "gains_percent")).alias("text"))
    depot = numbered(each, ["k"], ["a", "isin"], "n").select(F.lit(5).alias("section"), F.lit(1).alias("part"), "n", "text")
    summary = R.first_depot(depots, positions).where("position_count > 0").select(F.lit(5).alias("section"), F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit(f"| {REPORT_TOTAL} | | | "), bold(euro("total_value")), F.lit(" | "), bold(gain("total_gains", "total_gains_percent")), F.lit(" |")).alias("text"))
    traded = dealt.select((-F.unix_date("date")).alias("a"), "transaction_id", _line(F.coalesce(F.col("date").cast("string"), F.lit("?")), F.coalesce("transaction_type", F.lit("?")), F.coalesce("name", F.lit("?")), _plain(F.col("quantity")), euro("amount")).alias("text"))
    traded = ranked(traded, 6, F.col("a").isNull().alias("u"), F.col("a"), F.col("transaction_id"))
    body = _together(lines.select(F.lit(1).alias("section"), F.lit(1).alias("part"), "n", "text"), all_, spent, largest, often, depot, summary, traded)
    there = body.groupBy("section").agg(F.lit(1).alias("_"))
    heads = F.create_map(*[x for k, v in REPORT_HEADS.items() for x in (F.lit(k), F.array(*map(F.lit, ("", v[0], "", *v[1:]))))])
    headed = there.select("section", F.posexplode(heads[F.col("section")]).alias("at", "text")).select("section", F.lit(0).alias("part"), F.col("at").cast("bigint").alias("n"), "text")
    ends = one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(0).alias("part"), F.lit(n).cast("bigint").alias("n"), F.lit(text).alias("text")) for s, n, text in ((0, 0, REPORT_TITLE + day), (0, 1, ""), (0, 2, f"{REPORT_STATE}{exported_at}*"), (9, 0, ""), (9, 1, "---"), (9, 2, f"*Generiert am {day}*"))])).alias("e")).select("e.*")
    return _together(ends, headed, body)
