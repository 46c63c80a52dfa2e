"""Readers and the transaction model on small fixtures."""

import base64
import json
from datetime import date
from decimal import Decimal

import pytest

from tallyhouse.functions.text import html_text, line_items
from tallyhouse.sources import canonical, files


def test_bank_rows_hash_as_published(spark):
    raw = {"transactionId": None, "bookingDate": "2026-02-01", "valutaDate": "2026-02-01", "amount": "-1200.00", "currency": "EUR", "remittanceInfo": "Miete Februar 2026", "creditor": {"holderName": "ACME Immobilien GmbH", "iban": "DE99999999999999990001"}}
    row = canonical.content_hash(canonical.bank(spark.createDataFrame([(json.dumps(raw),)], "raw string"))).first()
    assert (row["recipient"], row["sender"], row["amount"]) == ("ACME Immobilien GmbH", None, Decimal("-1200.00"))
    assert row["content_hash"] == "6f52f7661e3b3b7779b465557ae6441611b3240e7b9cb426a886dafd2b8b3988"


def test_hash_escapes_beyond_ascii(spark):
    import hashlib

    fields = {"external_id": "1", "booking_date": "2026-02-01", "valuation_date": "2026-02-01", "amount": "1.00", "currency": "EUR", "sender": "Bäcker 😀", "recipient": None, "sender_iban": None, "recipient_iban": None, "description": "ß"}
    df = spark.createDataFrame([("wallet", *fields.values())], "source string, " + ", ".join(f"{k} string" for k in fields))
    want = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert canonical.content_hash(df).first()["content_hash"] == want


def test_credit_comes_from_the_remitter(spark):
    raw = {"bookingDate": "2026-02-01", "amount": {"value": "10.005", "unit": "USD"}, "remitter": {"holderName": "Boss"}, "debtor": {"holderName": "Bank"}, "reference": "r"}
    row = canonical.bank(spark.createDataFrame([(json.dumps(raw),)], "raw string")).first()
    assert (row["sender"], row["amount"], row["currency"], row["external_id"], row["valuation_date"]) == ("Boss", Decimal("10.00"), "USD", "r", date(2026, 2, 1))


def test_card_rows(spark):
    schema = "id string, bookingDate string, valueDate string, merchant string, amount string, currency string, originalAmount string, originalCurrency string, cardLast4 string"
    rows = [("a", "2026-02-01", None, "Shop", "-91.80", "EUR", "-99.00", "USD", "1111"), (None, "2026-02-02", "2026-02-03", "Refund", "7.40", "EUR", None, None, "1111")]
    a, b = canonical.card(spark.createDataFrame(rows, schema)).collect()
    assert (a["recipient"], a["original_amount"], a["original_currency"]) == ("Shop", Decimal("-99.00"), "USD")
    assert (b["sender"], b["original_amount"]) == ("Refund", None) and b["external_id"].startswith("card-") and len(b["external_id"]) == 21


HEADER = "Datum,Uhrzeit,Beschreibung,Währung,Brutto,Name,Transaktionscode,Zugehöriger Transaktionscode"


@pytest.mark.parametrize("sep", [",", ";"])
def test_wallet(spark, tmp_path, sep):
    rows = [HEADER.split(","), ["08.05.2026", "14:23", "Zahlung", "EUR", "-1.270,99", "PayPal *Shop", "T0", ""], ["08.05.2026", "1", "Zahlung", "EUR", "-19,99", "PP*Test Merchant", "T1", ""], ["09.05.2026", "1", "Zahlung", "USD", "-50,00", "Foreign", "T2", ""],
            ["09.05.2026", "1", "Allgemeine Währungsumrechnung", "EUR", "-46,10", "", "T3", "T2"], ["10.05.2026", "1", "Bankgutschrift auf PayPal-Konto", "EUR", "50,00", "", "T4", ""], ["", "", "", "", "", "", "", ""]]
    path = tmp_path / "w.csv"
    path.write_text("﻿" + "\n".join(sep.join(f'"{c}"' for c in r) for r in rows), encoding="utf-8")
    got = {r["external_id"]: r for r in files.wallet(files.wallet_rows(spark, str(path))).collect()}
    assert set(got) == {"T1", "T2", "T4"}
    assert (got["T1"]["recipient"], got["T1"]["amount"], got["T1"]["booking_date"]) == ("Test Merchant", Decimal("-19.99"), date(2026, 5, 8))
    assert (got["T2"]["amount"], got["T2"]["currency"], got["T2"]["original_amount"], got["T2"]["original_currency"]) == (Decimal("-46.10"), "EUR", Decimal("-50.00"), "USD")
    assert got["T4"]["description"] == "Bankgutschrift auf PayPal-Konto"


def test_wallet_names_missing_columns(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Datum,Name\n1,2\n")
    with pytest.raises(ValueError, match="transaction_id, gross, currency"):
        files.wallet_rows(spark, str(tmp_path / "w.csv"))


def test_separator_of_the_first_characters():
    assert files.separator("a;b;c\n1,5;2,5;3\n1,5;2,5;3\n") == ";"
    assert files.separator('a,b\n"x;y;z\nmore;text",2\n') == ","
    assert files.separator("one column\nx\n") == "," and files.separator("") == ","
    # a title before the header does not decide, nor does a line that the 4096 characters cut
    assert files.separator("Report, all of it\na;b\n" + "1;2\n" * 2000) == ";"
    assert files.separator("a;b\n" + "x" * 4000 + ";2\n" + ",,,,,," * 100) == ";"


def test_wallet_files_count_each_for_itself(spark, tmp_path):
    def put(name, sep, rows):
        (tmp_path / name).write_text("\n".join(sep.join(f'"{c}"' for c in r) for r in rows), encoding="utf-8")

    row = ["08.05.2026", "1", "Zahlung", "EUR", "-19,99", "Shop", "T1", ""]
    put("a.csv", ",", [HEADER.split(","), row])
    put("b.csv", ";", [HEADER.split(","), [*row[:6], "T2", ""]])
    put("c.csv", ",", [["Datum", "Name"], ["1", "2"]])
    (tmp_path / "d.csv").write_bytes(b"\xff\xfe broken")
    rows, errors = files.wallet_files(spark, str(tmp_path / "*.csv"))
    assert sorted((r["external_id"], r["amount"]) for r in files.wallet(rows).collect()) == [("T1", Decimal("-19.99")), ("T2", Decimal("-19.99"))]
    assert {r["file"].rsplit("/", 1)[1][0] for r in rows.collect()} == {"a", "b"}
    told = {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert set(told) == {"c.csv", "d.csv"} and "transaction_id" in told["c.csv"] and "UTF-8" in told["d.csv"]
    with pytest.raises(ValueError, match="c.csv.*d.csv"):
        files.wallet_files(spark, str(tmp_path / "[cd].csv"))


STATEMENT = """Rechnungsdatum 20.01.2026
************1111
9999 before the frame 9999 1,00
SALDOVORTRAG 100,00
1512 Test Merchant 1212 40,00
0501 Foreign Shop USD 50,00 0.9000 0401 45,00
0601 Twice 0501 5,00
0601 Twice 0501 5,00
0701 Back 0601 20,00 H
FINANZIERUNGSGEBÜHR 3,00
NEUER SALDO IN EURO 178,00
"""


def test_card_statement(spark):
    texts = spark.createDataFrame([("a", STATEMENT), ("b", STATEMENT.replace("178,00", "179,00"))], "file string, text string")
    bookings, balances = files.card_statement(texts)
    assert {r["file"]: r["balanced"] for r in balances.collect()} == {"a": True, "b": False}
    rows = bookings.where("file = 'a'").collect()
    assert len(rows) == 6 and len({r["external_id"] for r in rows}) == 6
    by = {r["merchant"]: r for r in rows}
    assert by["Test Merchant"]["booking_date"] == date(2025, 12, 15) and by["Foreign Shop"]["original_amount"] == Decimal("50.00") and by["Back"]["amount"] == Decimal("20.00")
    assert by["FINANZIERUNGSGEBÜHR"]["booking_date"] == date(2026, 1, 20) and by["FINANZIERUNGSGEBÜHR"]["amount"] == Decimal("-3.00")


def test_json_export(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"transactions": {"A": [{"bookingDate": "2026-01-01", "amount": "1.00"}, {"bookingDate": "2026-01-02", "amount": "2.00"}], "B": []}}))
    rows = files.json_export(spark, str(tmp_path / "e.json"))
    assert sorted((r["account_id"], json.loads(r["raw"])["amount"]) for r in rows.collect()) == [("A", "1.00"), ("A", "2.00")]
    assert canonical.bank(rows).count() == 2


def test_mail_and_html(spark):
    body = base64.urlsafe_b64encode("Total: 5,00 €".encode()).decode()
    rows = spark.createDataFrame([("m", "1", date(2026, 1, 1), "a@b.c", "s", body, None), ("m", "2", None, "a@b.c", "s", None, "<p>A&amp;B<script>x</script></p><b>c</b>")], "source string, source_message_id string, received_at date, sender string, subject string, body string, html string")
    assert [r["body_text"] for r in files.mail_messages(rows).orderBy("source_message_id").collect()] == ["Total: 5,00 €", "A&B c"]
    assert spark.createDataFrame([("<style>p{}</style>x<!-- y -->",)], "h string").select(html_text(__import__("pyspark.sql.functions", fromlist=["col"]).col("h"))).first()[0] == "x"


def test_line_items(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([("- Milk | 1,29 | food\nno item\n* Bread | x\n- | 3\n",)], "t string").select(line_items(F.col("t"))).first()[0]
    assert [(i["label"], i["amount"], i["category_hint"]) for i in items] == [("Milk", Decimal("1.29"), "food"), ("Bread", None, None)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", date(2026, 1, 2), date(2026, 1, 3), "d", "r", None, Decimal("-1234.50"))], "id string, booking_date date, valuation_date date, description string, recipient string, sender string, amount decimal(14,2)")
    files.write_statement(rows, str(tmp_path / "o"))
    assert any('"02.01.2026";"03.01.2026";"r d";"-1.234,50"' in p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text("isin,date,close,currency\nA,2026-01-02,2.0,EUR\nA,2026-01-01,1.0,EUR\nB,2026-01-01,1.0,USD\n")
    assert [str(r["date"]) for r in files.prices(spark, str(tmp_path / "p.csv")).collect()] == ["2026-01-01", "2026-01-02"]
