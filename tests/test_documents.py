"""Documents that are written in pieces are whole when read one file after another."""

import json
from datetime import date
from decimal import Decimal

from tallyhouse.operators import documents as D

DAY = date(2026, 5, 1)
BOOKINGS = "account_id string, id string, booking_date date, valuation_date date, type_text string, description string, amount decimal(14,2), currency string, creditor_name string, creditor_iban string, debtor_name string, debtor_iban string"
HELD = "depot_id string, isin string, quantity decimal(18,6), current_value decimal(18,2), purchase_value decimal(18,2)"
TRADES = "depot_id string, isin string, booking_date date, transaction_type string, quantity decimal(18,6), amount decimal(14,2), id string"


def booking(account, id_, day, amount, who=None, text=None, kind=None):
    return (account, id_, day, day, kind, text, None if amount is None else Decimal(amount), "EUR", who, "DE1", "Payer", "DE2")


def tables(spark, bookings=(), accounts=(), depots=(), positions=(), trades=(), instruments=()):
    make = spark.createDataFrame
    return [make(list(bookings), BOOKINGS), make(list(accounts), "account_id string, account_type string"), make(list(depots), "depot_id string, name string"), make(list(positions), HELD), make(list(trades), TRADES), make(list(instruments), "isin string, name string")]


def whole(document, path):
    D.write(document, str(path))
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


FULL = dict(
    bookings=[
        booking("a", "1", DAY, "-10.00", 'Shop "x", \\ y', "line\nend"), booking("b", "2", DAY, "5.50"), booking("b", "2", DAY, "5.50"), booking("c", "3", None, "-1.25", "Shop", "ü" * 60),
        booking("c", "4", date(2026, 1, 1), None), booking("gone", "5", DAY, "-99.00", "Other"), booking(None, "6", DAY, "1.00")],
    accounts=[("a", "Giro"), ("b", "CA"), ("c", "Credit Card"), ("d", None)],
    depots=[("D2", "second"), ("D1", "first")],
    positions=[("D1", "I2", Decimal("1.5"), Decimal("120.00"), Decimal("100.00")), ("D1", "I1", Decimal("1000"), Decimal("90.00"), Decimal("0.00")), ("D2", "I1", Decimal("3"), Decimal("1.00"), Decimal("2.00"))],
    trades=[("D1", "I2", DAY, "BUY", Decimal("1.5"), Decimal("-100.00"), "t1"), ("D1", "I1", date(2025, 1, 1), "SELL", Decimal("2"), Decimal("7.00"), "t0"), ("D2", "I1", None, "BUY", None, None, "t2")],
    instruments=[("I1", "One")])


def test_agent_document(spark, tmp_path):
    found = json.loads(whole(D.agent_document(*tables(spark, **FULL), "now"), tmp_path / "d"))
    assert list(found) == ["meta", "credit_card", "girokonto", "unknown", "depot"]
    # a and b are one account; the booking of an account that is not listed, and that of none, have no place
    assert found["meta"] == {"exported_at": "now", "account_count": 4, "total_transaction_count": 7}
    giro = found["girokonto"]
    assert giro["account_id"] == "a" and giro["summary"] == {"total_in": 11.0, "total_out": 10.0, "net": 1.0, "count": 3}
    assert [t["transaction_id"] for t in giro["transactions"]] == ["1", "2", "2"]
    assert giro["transactions"][0]["counterpart_name"] == 'Shop "x", \\ y' and giro["transactions"][0]["text"] == "line\nend" and giro["transactions"][1]["counterpart_iban"] == "DE2"
    card = found["credit_card"]
    assert [(t["transaction_id"], t["date"], t["amount"]) for t in card["transactions"]] == [("3", None, -1.25), ("4", "2026-01-01", None)]
    # a booking without an amount is one all the same
    assert card["summary"] == {"total_in": 0.0, "total_out": 1.25, "net": -1.25, "count": 2}
    assert found["unknown"] == {"account_id": "d", "summary": {"total_in": 0.0, "total_out": 0.0, "net": 0.0, "count": 0}, "transactions": []}
    depot = found["depot"]
    assert depot["depot_id"] == "D1" and depot["summary"] == {"total_value": 210.0, "total_purchase_value": 100.0, "total_gains": 110.0, "total_gains_percent": 110.0, "position_count": 2}
    assert [(p["isin"], p["name"], p["gains"], p["gains_percent"]) for p in depot["positions"]] == [("I1", "One", 90.0, 0.0), ("I2", None, 20.0, 20.0)]
    assert [t["transaction_id"] for t in depot["transactions"]] == ["t0", "t1"]


def test_empty_documents(spark, tmp_path):
    found = json.loads(whole(D.agent_document(*tables(spark), "now"), tmp_path / "d"))
    assert found["meta"] == {"exported_at": "now", "account_count": 0, "total_transaction_count": 0}
    assert found["depot"] == {"depot_id": "", "summary": {"total_value": 0.0, "total_purchase_value": 0.0, "total_gains": 0.0, "total_gains_percent": 0.0, "position_count": 0}, "positions": [], "transactions": []}
    found = json.loads(whole(D.export_document(*tables(spark)[:5], "now"), tmp_path / "e"))
    assert found.pop("meta")["transaction_count"] == 0 and found == {"accounts": [], "depots": [], "transactions": {}, "depot_positions": {}, "depot_transactions": {}}
    lines = whole(D.report(*tables(spark), "2026-05-02", "now"), tmp_path / "r").split("\n")
    assert "## Depot" not in lines and "| **Gesamt** | **0,00 EUR** | **0,00 EUR** | **0,00 EUR** | **0** |" in lines


def test_export_document(spark, tmp_path):
    found = json.loads(whole(D.export_document(*tables(spark, **FULL)[:5], "now", "2026-02-01"), tmp_path / "d"))
    meta = found["meta"]
    assert (meta["transaction_count"], meta["depot_transaction_count"], meta["position_count"], meta["account_count"], meta["depot_count"], meta["since"]) == (6, 2, 3, 4, 2, "2026-02-01")
    # bookings of no account are kept under an empty name; those without a day stay
    assert {k: [t["id"] for t in v] for k, v in found["transactions"].items()} == {"": ["6"], "a": ["1"], "b": ["2", "2"], "c": ["3"], "gone": ["5"]}
    assert {k: [t["isin"] for t in v] for k, v in found["depot_positions"].items()} == {"D1": ["I1", "I2"], "D2": ["I1"]}
    assert {k: [t["id"] for t in v] for k, v in found["depot_transactions"].items()} == {"D1": ["t1"], "D2": ["t2"]}
    assert [d["depot_id"] for d in found["depots"]] == ["D1", "D2"] and found["accounts"][3] == {"account_id": "d", "account_type": None}


def test_report(spark, tmp_path):
    bookings = [*FULL["bookings"], *[booking("a", f"x{k}", DAY, "-1.00", "Often") for k in range(3)]]
    lines = whole(D.report(*tables(spark, **FULL | {"bookings": bookings}), "2026-05-02", "now"), tmp_path / "r").split("\n")
    assert lines[:4] == ["# Finanzreport — 2026-05-02", "", "*Datenstand: now*", ""]
    giro = lines.index("| Girokonto | 11,00 EUR | 13,00 EUR | -2,00 EUR | 6 |")
    assert lines[giro - 1].startswith("| Credit Card |") and lines[giro + 2] == "| **Gesamt** | **11,00 EUR** | **14,25 EUR** | **-3,25 EUR** | **8** |"
    assert lines[lines.index("## Top-Ausgaben nach Empfänger") + 4 :][:3] == ['| Shop "x", \\ y | 10,00 EUR | 1x |', "| Often | 3,00 EUR | 3x |", "| Shop | 1,25 EUR | 1x |"]
    assert "| ? | -1,25 EUR | Shop | " + "ü" * 47 + "... |" in lines
    assert "| Often | 3x |" in lines and not any(line.startswith("| Shop | 1x") for line in lines)
    depot = lines.index("## Depot")
    assert lines[depot + 4 : depot + 7] == ["| ? | I2 | 1.5 | 120,00 EUR | 20,00 EUR (+20,00 %) |", "| One | I1 | 1000 | 90,00 EUR | 90,00 EUR (+0,00 %) |", "| **Gesamt** | | | **210,00 EUR** | **110,00 EUR (+110,00 %)** |"]
    assert lines[lines.index("## Depot-Transaktionen") + 4 :][:2] == ["| 2026-05-01 | BUY | ? | 1.5 | -100,00 EUR |", "| 2025-01-01 | SELL | One | 2 | 7,00 EUR |"]


def test_small_percentages_are_written_out(spark, tmp_path):
    """No exponent, no zeros at the end, and the sign of a loss that rounds to nothing."""
    values = [("100000.00", "99999.50"), ("99999.99", "100000.00"), ("112.50", "100.00"), ("1000000.00", "1000000.01"), ("5.00", "5.00"), ("5.00", "0.00"), ("200000.00", "0.01")]
    held = [("D1", f"I{k}", Decimal("1"), Decimal(v), Decimal(p)) for k, (v, p) in enumerate(values)]
    text = whole(D.agent_document(*tables(spark, depots=[("D1", "first")], positions=held), "now"), tmp_path / "d")
    found = [x.split("}")[0] for x in text.split('"gains_percent":')[1:]]
    assert found == ["0.0005", "-0.0", "12.5", "-0.0", "0.0", "0.0", "1999999900.0"]
    assert "E" not in "".join(found) and json.loads(text)["depot"]["summary"]["position_count"] == 7
