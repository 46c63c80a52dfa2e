"""Operators whose rows depend on order or ties, on cases small enough to work out."""

from datetime import date, timedelta
from decimal import Decimal
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import enrich, evidence, pairing, versions

DAY = date(2026, 1, 1)


def ledger(spark, rows):
    """Rows of (id, day, amount[, sender_iban, recipient_iban])."""
    full = [(i, DAY + timedelta(d), Decimal(str(a)), *(more or ("DE0", "X"))) for i, d, a, *more in rows]
    return spark.createDataFrame(full, "id string, booking_date date, amount decimal(14,2), sender_iban string, recipient_iban string")


def test_pairs_are_first_come_and_used_once(spark):
    rows = [("c1", 0, 5), ("c2", 1, 5), ("d1", 2, -5), ("d2", 2, -5), ("d3", 9, -5), ("c3", 12, 5), ("c4", 20, 7), ("d4", 18, -7), ("c5", 30, 1.01), ("d5", 30, -1)]
    assert sorted(map(tuple, pairing.internal_transfers(ledger(spark, rows), []).collect())) == [("c1", "d1"), ("c2", "d2"), ("c4", "d4")]


def test_pairs_equal_a_plain_loop(spark):
    import random

    r = random.Random(5)
    rows = [(f"{i:03d}", r.randrange(12), r.choice([3, -3, 4, -4])) for i in range(120)]
    used, want = set(), []
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    for i, d, a in order:
        if a > 0 and (hit := next((j for j, e, b in order if b == -a and j not in used and abs(d - e) <= 2), None)):
            used.add(hit)
            want.append((i, hit))
    assert sorted(map(tuple, pairing.matched(ledger(spark, rows)).collect())) == sorted(want)


def test_transfers_need_own_accounts(spark):
    rows = [("c", 0, 5, "DE1", None), ("d", 0, -5, None, "DE9")]
    assert pairing.internal_transfers(ledger(spark, rows), ["DE1"]).count() == 0
    assert pairing.internal_transfers(ledger(spark, rows), ["DE1", "DE9"]).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-6, 6).filter(bool), max_size=8), st.integers(-12, 12).filter(bool))
def test_only_subset(values, target):
    ways = [c for n in range(1, len(values) + 1) for c in combinations(range(len(values)), n) if sum(values[k] for k in c) == target]
    assert pairing.only_subset(target, values) == (list(ways[0]) if len(ways) == 1 else None)


def test_link_ids_are_version_5_uuids(spark):
    import uuid

    names = [f"x:{k}:ü" for k in range(40)] + ["", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(text.uuid5(F.col("n"))).collect()] == [n if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    links = spark.createDataFrame([("a", "b")], "p string, c string").select(pairing.link_id(F.lit("top_up"), F.col("p"), F.col("c"), "book"))
    assert links.first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "book:top_up:a:b"))


def test_collective_debits(spark):
    schema = "id string, account string, booking_date date, amount decimal(14,2)"
    row = lambda i, d, a: (i, "x", DAY + timedelta(d), Decimal(str(a)))
    parents = spark.createDataFrame([row("p1", 0, -25), row("p2", 30, -10)], schema)
    children = spark.createDataFrame([row("a", 0, -20), row("b", 1, -10), row("c", 0, 5), row("d", 3, -25), row("e", 30, -5), row("f", 30, -5), row("g", 30, -10), row("h", 30, -10)], schema)
    assert sorted(map(tuple, pairing.collective_debits(parents, children, "account").collect())) == [("p1", "a"), ("p1", "b"), ("p1", "c")]


def test_settlement_window(spark):
    card = ledger(spark, [("a", 9, -90), ("b", 19, -60)])
    cycles = pairing.card_cycles(card)
    for day, n in ((40, 1), (6, 1), (5, 0)):
        assert pairing.settlements(cycles, ledger(spark, [("s", day, -150)])).count() == n


def test_outliers_with_and_without_spread(spark):
    rows = [("a", v) for v in (10, 12, 9, 11, 10.5, 9.5, 11.5, 10.2, 11.8, 9.8, 1000)] + [(None, v) for v in (5, 5, 5, 5, 5, 5, 90)] + [("b", 1), ("b", 1000)]
    got = enrich.outliers(spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double"), "g", "v").collect()
    assert sorted(r["v"] for r in got) == [90, 1000]


def test_recurring_needs_an_unbroken_run(spark):
    rows = [(f"{w}{m}", date(2026, m, 3), Decimal(-10 if w != "var" else -10 * m), w, None) for w, ms in (("run", (1, 2, 3)), ("gap", (1, 2, 4)), ("var", (1, 2, 3))) for m in ms]
    patterns, flags = enrich.recurring(spark.createDataFrame(rows, "id string, booking_date date, amount decimal(14,2), recipient string, sender string"))
    assert [r["counterpart"] for r in patterns.collect()] == ["run"] and flags.count() == 3


def test_versions_chain(spark):
    rows = spark.createDataFrame([("s", "x", "h1", 1), ("s", "x", "h2", 2), ("s", "x", "h1", 3), ("s", None, "h3", 4)], "source string, external_id string, content_hash string, arrival int")
    first = versions.insert_versions(versions.versions(rows.where("arrival = 1")), rows)
    again = versions.insert_versions(first, rows)
    want = {("h1", 1, "h2"), ("h2", 2, None), ("h3", 1, None)}
    for got in (versions.versions(rows), first, again):
        assert {(r["content_hash"], r["version"], r["superseded_by"]) for r in got.collect()} == want


def test_upsert_keys_may_be_null(spark):
    a = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    b = spark.createDataFrame([(None, 2), (2, 2)], "k int, v int")
    assert sorted(map(tuple, versions.upsert(a, b, ["k"]).collect()), key=str) == [(1, 1), (2, 2), (None, 2)]


def test_carried_over(spark):
    rows = spark.createDataFrame([("old", "food"), ("new", None), ("x", "y")], "id string, category string")
    moves = spark.createDataFrame([("old", "new")], "old string, new string")
    assert sorted(map(tuple, versions.carried_over(rows, moves, ["category"]).collect())) == [("new", "food"), ("x", "y")]


MAIL = "Merchant: ACME Shop GmbH\nDate: 2026-02-03\nTotal: EUR 42,99\nOrder: AB-12345\nPayment: PayPal\n- Shirt | 42,99 | clothes\n"


def test_evidence_and_match(spark):
    messages = spark.createDataFrame([("mail", "1", DAY, "x@acme.example", "Your receipt", MAIL)], "source string, source_message_id string, received_at date, sender string, subject string, body_text string")
    draft = evidence.extracted(messages)
    row = draft.first()
    assert (row["merchant_key"], row["total_amount"], row["document_date"], row["evidence_type"], row["payment_method"]) == ("acme shop", Decimal("42.99"), date(2026, 2, 3), "receipt", "paypal")
    assert row["confidence"] == Decimal("0.999") and "AB-12345" not in str(row) and evidence.usable(draft).count() == 1
    tx = [("t1", date(2026, 2, 4), Decimal("-42.99"), None, "PAYPAL *ACME", "", False), ("t2", date(2026, 2, 4), Decimal("42.99"), "x", None, "", False), ("t3", date(2026, 2, 12), Decimal("-42.99"), None, "acme", "", False), ("t4", date(2026, 2, 10), Decimal("-42.99"), None, "other", "", False)]
    found = evidence.match_scores(draft, spark.createDataFrame(tx, "id string, booking_date date, amount decimal(14,2), sender string, recipient string, description string, internal_transfer boolean")).collect()
    # the processor's name is no part of a merchant's, so that it proves no payment by it
    assert [(r["id"], r["score"], r["reasons"], r["match_type"]) for r in found] == [("t1", 900, "amount+date<=1d+merchant", "receipt_match")]


def test_evidence_of_scanty_mails(spark):
    rows = [("mail", "1", DAY, "shop@x.example", "Hello", "nothing"), (None, None, DAY, "shop@x.example", "Hello", "Total: -12,50 EUR\n- | 1\n- DE12345678901234567890 | 2,00\n- Pen | x | office\nPayment: Visa of a@b.example")]
    got = evidence.extracted(spark.createDataFrame(rows, "source string, source_message_id string, received_at date, sender string, subject string, body_text string")).orderBy("confidence").collect()
    assert [str(r["confidence"]) for r in got] == ["0.300", "0.700"] and got[0]["order_ref_hash"] is None and got[0]["document_date"] == DAY
    second = got[1]
    assert (second["source"], second["merchant_name"], second["total_amount"], second["payment_method"], second["payment_hint"]) == ("gmail", "shop", Decimal("12.50"), "credit_card", "Visa of [email]")
    assert [(i["label"], i["amount"]) for i in second["line_items"]] == [("DE[iban]", Decimal("2.00")), ("Pen", None)] and second["subject_hint"] == "Hello"
    assert got[0]["evidence_id"] != second["evidence_id"]


def test_evidence_of_a_batch_is_put_in_once(spark):
    kind = "evidence_id string, source string, order_ref_hash string, evidence_type string, total_amount int"
    stored = spark.createDataFrame([("a", "g", "h1", "order", 1), ("b", "g", None, "order", 2)], kind)
    drafts = spark.createDataFrame([("x", "g", "h1", "order", 10, 1), ("b", "g", "h9", "order", 20, 2), ("p", "g", "h2", "order", 30, 3), ("q", "g", "h2", "order", 40, 4), ("r", "g", None, "order", 50, 5)], kind + ", seq int")
    got = {r["evidence_id"]: (r["order_ref_hash"], r["total_amount"]) for r in evidence.upsert_evidence(stored, drafts, "seq").collect()}
    assert got == {"a": ("h1", 10), "b": ("h9", 20), "p": ("h2", 40), "r": (None, 50)}


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(text.german_decimal, "-1.234,56") == Decimal("-1234.56") and one(text.german_decimal, "1.234.567") == Decimal("1234567.00") and one(text.german_decimal, "") == 0 and one(text.german_decimal, "x") is None
    assert one(text.mixed_decimal, "1.234,50") == Decimal("1234.50") and one(text.mixed_decimal, "12.345") == Decimal("12.34")
    assert [str(one(text.any_date, d)) for d in ("2026-02-03", "3.2.2026", "03/02/2026", "31.02.2026")] == ["2026-02-03"] * 3 + ["None"]
    assert one(text.evidence_type, "Rückerstattungen und Abo") == "subscription" and one(text.evidence_type, "Rückerstattung") == "refund"
    assert one(text.redact, "ref: AB-12345 x@y.de") == "ref [ref] [email]" and one(text.redact, " ") is None
    assert one(text.web_query, "Bäcker <b> x@y.de DE12345678901234567890") == "Bäcker b"
    assert one(text.remittance, "01" + "Miete".ljust(35) + "02Mai") == "Miete, Mai"
