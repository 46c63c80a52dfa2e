"""The whole pass, replay and readers on cases small enough to work out."""

import json
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import numbers, text
from tallyhouse.operators import changes, enrich, normalise, prompts
from tallyhouse.operators import reports as R
from tallyhouse.sources import canonical, files
from tallyhouse.streaming import ingest

OWN = ["DE00000000000000000000", "DE00000000000000000001"]
RULES = [("rewe|aldi", "groceries", 50), ("miete", "rent", 10), ("netflix", "streaming", 10), ("gehalt", "salary", 90)]


def booking(i, day, amount, name, text_="", iban=None):
    side = {"holderName": name, **({"iban": iban} if iban else {})}
    return json.dumps({"transactionId": i, "bookingDate": str(day), "transactionValue": {"value": str(amount), "unit": "EUR"}, "creditor" if amount < 0 else "remitter": side, "remittanceInfo": text_})


def bookings():
    day = lambda m, d: date(2026, m, d)
    rows = [booking(f"R{m}", day(m, 1), -1200, "ACME Immobilien", "Miete") for m in (2, 3, 4, 5)]
    rows += [booking(f"N{m}", day(m, 5), -12.99, "Netflix", "Abo") for m in (2, 3, 5)]  # April is missing
    rows += [booking(f"G{k}", day(2, 3) + timedelta(days=9 * k), a, "REWE", "Markt") for k, a in enumerate((-41, -39.5, -44, -38, -42, -40, -610))]
    rows += [booking("U1", day(3, 10), -500, "me", "", OWN[1]), booking("U2", day(3, 11), 500, "me", "", OWN[0]), booking("U3", day(3, 20), -500, "me", "", OWN[1])]
    rows += [booking("P1", day(4, 2), -50, "PayPal Europe"), booking("P2", day(4, 20), -25, "PayPal Europe"), booking("C1", day(5, 2), -90, "Santander Karte"), json.dumps({"transactionId": "open", "transactionValue": {"value": "-5"}})]
    wallet = [("W1", day(4, 3), "50.00", "Bank", None), ("W2", day(4, 19), "-20.00", None, "Shop A"), ("W3", day(4, 21), "-10.00", None, "Shop B"), ("W4", day(4, 21), "5.00", "Shop B", None)]
    card = [("K1", day(4, 4), "-60.00", "Hotel"), ("K2", day(4, 9), "-30.00", "Cafe")]
    out = [("bank", r) for r in rows]
    out += [("wallet", json.dumps({"external_id": i, "booking_date": str(d), "amount": a, "currency": "EUR", "sender": s, "recipient": r, "description": "x"})) for i, d, a, s, r in wallet]
    return out + [("card", json.dumps({"id": i, "bookingDate": str(d), "merchant": n, "amount": a, "currency": "EUR", "cardLast4": "1111"})) for i, d, a, n in card]


EMPTY = "source string, external_id string, content_hash string, arrival long, raw string, version long, superseded_by string"


def test_whole_pass(spark):
    incoming = spark.createDataFrame([(s, r, k) for k, (s, r) in enumerate(bookings())], "source string, raw string, arrival long")
    kept, found = normalise.ingested(spark.createDataFrame([], EMPTY), incoming, RULES, OWN)
    rows = {r["external_id"]: r for r in found.ledger.collect()}
    assert len(rows) == kept.count() - 1 and "open" not in rows  # no day, no booking
    assert {i for i, r in rows.items() if r["is_recurring"]} == {"R2", "R3", "R4", "R5"}
    assert {i for i, r in rows.items() if r["is_outlier"]} == {"G6", "U3"}  # U3 stands among small ones without a category
    assert {i for i, r in rows.items() if r["internal_transfer"]} == {"U1", "U2", "P1", "W1", "P2", "C1"}
    assert {rows[i]["category_id"] for i in ("R2", "G0", "N2", "U1")} == {"rent", "groceries", "streaming", None}
    name = {r["id"]: i for i, r in rows.items()}
    links = {(name[r["parent_id"]], name[r["child_id"]], r["kind"]) for r in found.links.collect()}
    assert links == {("P1", "W1", "top_up"), ("P2", "W2", "collective"), ("P2", "W3", "collective"), ("P2", "W4", "collective"), ("C1", "K1", "settlement"), ("C1", "K2", "settlement")}
    again, same = normalise.ingested(kept, incoming, RULES, OWN)
    assert again.count() == kept.count() and same.ledger.count() == found.ledger.count()  # a replay adds nothing


def test_an_unknown_source_is_an_error(spark):
    for source in ("bourse", None):
        with pytest.raises(Exception, match="no adapter for source"):
            normalise.canonical(spark.createDataFrame([(source, "{}")], "source string, raw string")).collect()


def test_replay_hashes_as_reading_did(spark):
    read = canonical.content_hash(normalise.canonical(normalise.raw_rows(spark, [r for s, r in bookings() if s == "bank"], "bank")))
    records = read.select("source", F.struct(*[c for c in normalise.FIELDS if c != "source"]).alias("canonical"), F.col("content_hash").alias("want"))
    again = normalise.replayed(records.drop("want")).select("content_hash")
    assert sorted(r[0] for r in again.collect()) == sorted(r["content_hash"] for r in read.collect())


def test_accounts_and_positions_of_any_shape(spark):
    one = lambda f, *raw: [tuple(r) for r in f(spark.createDataFrame([(json.dumps(x),) for x in raw], "raw string")).collect()]
    got = one(canonical.accounts, {"account": {"accountId": "1", "iban": "DE1", "accountType": {"key": "CURRENT_ACCOUNT"}}, "balance": {"value": "12.5", "unit": "USD"}}, {"accountId": "2", "accountType": "SAVINGS_ACCOUNT", "balance": {"value": "500"}}, {})
    assert got == [("1", "DE1", "CURRENT_ACCOUNT", Decimal("12.50"), "USD"), ("2", "", "SAVINGS_ACCOUNT", Decimal("500.00"), "EUR"), ("", "", None, Decimal("0.00"), "EUR")]
    got = one(canonical.positions, {"instrument": {"isin": "I", "wkn": "W", "name": "N"}, "quantity": {"value": "10"}, "currentValue": {"value": "900"}, "purchaseValue": {"value": "800"}}, {"isin": "J", "stueckzahl": 2, "kurswert": {"value": 5}, "einstandswert": 0})
    assert [(r[0], float(r[3]), float(r[6]), r[7]) for r in got] == [("I", 10.0, 100.0, 12.5), ("J", 2.0, 5.0, 0.0)]
    kinds = spark.createDataFrame([("ca",), ("Credit Card",), (None,), ("",)], "k string").select(R.account_name(F.col("k"))).collect()
    assert [r[0] for r in kinds] == ["girokonto", "credit_card", "unknown", "unknown"]


STATEMENT = "Rechnungsdatum 05.06.2026\n************1111\nSALDOVORTRAG 100,00\n1505 Test Merchant 1205 40,00\nNEUER SALDO IN EURO {}\n"


def test_statements_fail_one_by_one(spark, tmp_path):
    for name, content in (("good.txt", STATEMENT.format("140,00")), ("wrong.txt", STATEMENT.format("150,00")), ("other.txt", "no statement"), ("empty.txt", "")):
        (tmp_path / name).write_text(content, encoding="utf-8")
    taken, errors = files.card_statements(spark, str(tmp_path / "*.txt"))
    assert [r["file"].rsplit("/", 1)[1] for r in taken.collect()] == ["good.txt"]
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()} == {"wrong.txt": "opening, bookings and closing do not agree", "other.txt": "not a statement"}
    with pytest.raises(ValueError, match="not a statement"):
        files.card_statements(spark, str(tmp_path / "other.txt"))


def test_a_file_in_another_encoding_is_refused(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Datum,Währung\n".encode("latin-1"))
    with pytest.raises(ValueError, match="not UTF-8"):
        files.wallet_rows(spark, str(tmp_path / "w.csv"))


def test_medians_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(enrich, "RANGES", 4)
    r = np.random.default_rng(1)
    values = {"a": r.normal(size=501), "b": r.integers(0, 3, 400).astype(float), None: r.exponential(size=100) * 1e9, "one": np.array([7.0]), "two": np.array([-1.0, 4.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r["g"]: r["median"] for r in enrich.medians(rows, ["g"], "v").collect()}
    assert set(got) == set(values) and all(abs(got[g] - np.median(v)) <= 1e-12 * max(1, abs(np.median(v))) for g, v in values.items())


def test_dates_ratios_and_prompts(spark):
    row = spark.sql("select date'2026-01-31' as d, date'2026-03-10' as today")
    got = row.select(numbers.month_later(F.col("d"), F.lit(1)), *[numbers.relative_start(F.lit(t), F.col("today")) for t in ("2026-02-01", "-7d", "30d", "4000d", "x")], numbers.even_ratio(F.lit("0.25").cast("decimal(18,2)"), F.lit(2), 2)).first()
    assert tuple(map(str, got)) == ("2026-02-28", "2026-02-01", "2026-03-03", "2026-02-08", "None", "None", "0.12")
    rows = spark.createDataFrame([(1, "b", "to a@b.example", "DE1"), (2, "a", "x", "DE2"), (3, "b", None, "DE3")], "seq int, transaction_id string, note string, sender_iban string")
    shown = sorted(tuple(r) for r in prompts.for_prompt(rows, "seq").collect())
    assert shown == [(1, "tx_001", "to [email]"), (2, "tx_002", "x"), (3, "tx_001", None)]
    metrics = spark.createDataFrame([('{"a": "1", "b": [1, 2]}',), ('[{"key": "a", "value": "1"}]',)], "j string").select(changes.metric_list(F.col("j"))).collect()
    assert [[tuple(m) for m in r[0]] for r in metrics] == [[("a", "1"), ("b", "[1,2]")], [("a", "1")]]


def test_reports_as_text(spark, tmp_path):
    rows = spark.createDataFrame([("x" * 60, Decimal("-1234.50"))], "name string, amount decimal(10,2)")
    page = R.markdown("Report", [("Top", rows)])
    assert "| name | amount |" in page and "-1.234,50 EUR" in page and "x" * 47 + "..." in page
    for name, content in (("agent", {"meta": {}, "depot": {}}), ("raw", {"transactions": {}}), ("none", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    assert R.is_agent_format(spark, str(tmp_path / "agent.json")) and not R.is_agent_format(spark, str(tmp_path / "raw.json"))
    with pytest.raises(ValueError):
        R.is_agent_format(spark, str(tmp_path / "none.json"))


def test_streams_in_several_batches(spark, tmp_path):
    """Limits and timers carry over from batch to batch."""
    for k, seconds in enumerate(([0, 10, 20], [30, 200, 205], [210, 215, 2000])):
        spark.createDataFrame([(10 * k + i, "u", s) for i, s in enumerate(seconds)] + ([(99, "quiet", 5)] if not k else []), "event long, user string, s long").selectExpr("event", "user", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(str(tmp_path / f"e/b{k}"))
    stream = lambda: spark.readStream.schema("event long, user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e/*"))
    assert sorted(r["event"] for r in ingest.limited(stream(), "event", "ts", "user", most=2, seconds=60).collect()) == [2, 10, 20, 21]
    assert {(r["key"], r["last"]) for r in ingest.stalled(stream(), "user", "ts", 300).collect()} >= {("quiet", 5)}


def test_stalls_are_told_when_all_was_read(spark, tmp_path):
    """Files that do not come in order of time: who comes back in a later one is not stalled, and late signs count."""
    for k, rows in enumerate(([("back", 0), ("busy", 5000)], [("back", 5000), ("late", 10)], [("late", 20), ("edge", 4899), (None, 3)])):
        spark.createDataFrame(rows, "user string, s long").selectExpr("user", "timestamp_seconds(s) as ts").coalesce(1).write.parquet(str(tmp_path / f"e/b{k}"))
    spark.sql("select 'busy' as user, timestamp_millis(5000900) as ts").coalesce(1).write.parquet(str(tmp_path / "e/b3"))
    stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e/*"))
    found = sorted(((r["key"], r["last"]) for r in ingest.stalled(stream, "user", "ts", 100).collect()), key=str)
    assert found == [("late", 20), (None, 3)]  # whole seconds: 4899 and a hundred are not before 5000 less one
