"""JSON of any shape, its keys, and windows of a source that is read back."""

import json
import random
from datetime import date, timedelta

import pytest

from tallyhouse.operators import backfill, ordering, payloads, prompts

CONTEXT = {
    "transaction_id": "t1", "nested": {"transaction_ids": ["t2", "t1", 7], "IBAN": "DE1", "rows": [{"evidence_id": "e1", "Order_No": 5, "note": "Bearer abcdefgh12345 to x@y.de  \n order: AB-1"}, None, [["Invoice_total"], {"token": {"a": 1}}]]},
    "amount": 12.5, "nothing": None, "flag": False, "webhook_url": "x", "list": [], "empty": {}, "transaction": "DE12345678901234567890 123456789",
}
CLEAN = {
    "transaction_id": "tx_001", "nested": {"transaction_ids": ["tx_002", "tx_001", "tx_003"], "rows": [{"evidence_id": "ev_001", "note": "Bearer [token] to [email] order [ref]"}, None, [["Invoice_total"], {}]]},
    "amount": 12.5, "flag": False, "list": [], "empty": {}, "transaction": "DE[iban] [number]",
}


def rows(spark, found, schema="k long, payload string, other string"):
    return spark.createDataFrame([(k, p, "kept") for k, p in found], schema).repartition(3)


def test_redaction_at_any_depth(spark):
    second = {"deep": [[[{"transaction_id": "t9", "evidence_id": "e1"}]]], "transaction_ids": "t2"}
    found = [(2, json.dumps(second)), (1, json.dumps(CONTEXT)), (3, None), (4, "no json"), (5, "[" * 20_000), (6, '"mail x@y.de"'), (7, ""), (8, "5")]
    got = {r["k"]: r["payload"] and json.loads(r["payload"]) for r in prompts.redacted(rows(spark, found), "k", "payload").collect()}
    assert got == {1: CLEAN, 2: {"deep": [[[{"transaction_id": "tx_004", "evidence_id": "ev_001"}]]], "transaction_ids": "t2"}, 3: None, 4: None, 5: None, 6: "mail [email]", 7: None, 8: 5}
    assert prompts.redacted(rows(spark, []), "k", "payload").count() == 0


def test_many_ids_are_numbered_in_order(spark):
    r = random.Random(3)
    ids = [r.randrange(900) for _ in range(3000)]
    got = prompts.redacted(rows(spark, [(k, json.dumps({"transaction_id": i})) for k, i in enumerate(ids)]), "k", "payload").collect()
    order = {i: n + 1 for n, i in enumerate(dict.fromkeys(ids))}
    assert {x["k"]: x["payload"] for x in got} == {k: f'{{"transaction_id":"tx_{order[i]:03d}"}}' for k, i in enumerate(ids)}


def test_numbers_are_those_of_a_plain_sort(spark):
    r = random.Random(5)
    found = [(r.choice("ab"), r.randrange(50), k) for k in range(700)]
    got = ordering.numbered(spark.createDataFrame(found, "key string, at int, id int").repartition(7), ["key"], ["at", "id"]).collect()
    want = {}
    for key in "ab":
        want |= {x[2]: n + 1 for n, x in enumerate(sorted((x for x in found if x[0] == key), key=lambda x: x[1:]))}
    assert {x["id"]: x["number"] for x in got} == want


def test_profile_of_payloads(spark):
    found = [(1, '{"a":1,"b":{"c":"x","d":null},"l":[1,"",[2,{"e":true}]]}'), (2, '{"a":1,"b":{"c":"y"}}'), (3, None), (4, "no"), (5, '"text"'), (6, "{}"), (7, '{"a":{"c":3}}')]
    got = {r["path"]: (r["filled"], r["n_values"], r["fill_rate"], r["uniqueness"], r["known"]) for r in payloads.profile(rows(spark, found), "payload", ["a", "ref"]).collect()}
    assert got == {"a": (2, 1, 0.2857, 0.5, True), "b.c": (2, 2, 0.2857, 1.0, False), "l[]": (1, 1, 0.1429, 1.0, False), "l[][]": (1, 1, 0.1429, 1.0, False), "l[][].e": (1, 1, 0.1429, 1.0, False), "a.c": (1, 1, 0.1429, 1.0, False), "ref": (0, 0, 0.0, 0.0, True)}


def test_profiles_are_merged_without_their_values(spark):
    parts = [payloads.profile(rows(spark, [(k, json.dumps({"id": k, "kind": k % 7})) for k in range(lo, lo + 4000)]), "payload") for lo in (0, 2000)]
    got = {r["path"]: (r["filled"], r["about_values"]) for r in payloads.merged(parts[0].union(parts[1])).collect()}
    assert got["id"][0] == got["kind"][0] == 8000 and abs(got["id"][1] - 6000) < 300 and got["kind"][1] == 7


def plain(counts, start, today, width, page):
    """The windows of one account, by asking for each."""
    out, end = [], today
    rows = lambda a, b: sum(n for d, n in counts.items() if a <= d <= b)
    while end >= start:
        w, halvings = width, 0
        first = max(start, end - timedelta(w - 1))
        while rows(first, end) >= page and halvings < 5:
            w, halvings = max(1, w // 2), halvings + 1
            first = max(start, end - timedelta(w - 1))
        n = rows(first, end)
        out.append((len(out), first, end, w, halvings, n, n < page))
        if n >= page or first <= start:
            break
        end = first - timedelta(1)
    return out


@pytest.mark.parametrize(("width", "page"), [(30, 40), (7, 9), (1, 4), (100, 1000), (64, 3)])
def test_windows_are_those_of_a_plain_walk(spark, width, page):
    r = random.Random(width)
    start, today = date(2025, 3, 1), date(2025, 6, 30)
    bookings = [(f"a{r.randrange(6)}", start + timedelta(r.randrange(-5, 128))) for _ in range(900)] + [("a0", None), (None, start), ("stranger", start)]
    accounts = spark.createDataFrame([(f"a{k}",) for k in range(7)] + [(None,)], "account string")  # a6 has no booking
    table = spark.createDataFrame(bookings, "account string, day date").repartition(4)
    windows = backfill.walked(accounts, table, str(start), str(today), width, page, strict=False)
    got = {}
    for w in windows.orderBy("account", "window").collect():
        got.setdefault(w["account"], []).append(tuple(w)[1:])
    counts = {f"a{k}": {} for k in range(7)}
    for a, d in bookings:
        if a in counts and d and start <= d <= today:
            counts[a][d] = counts[a].get(d, 0) + 1
    assert got == {a: plain(c, start, today, width, page) for a, c in counts.items()}
    assert backfill.read_back(windows, table).count() == sum(w[5] for ws in got.values() for w in ws if w[6])


def test_a_walk_that_cannot_go_on_is_an_error(spark):
    table = spark.createDataFrame([("a", date(2025, 1, 5))] * 9, "account string, day date")
    accounts = table.select("account").distinct()
    with pytest.raises(Exception, match="a page is full after all halvings: a 2025-01-05"):
        backfill.walked(accounts, table, "2025-01-01", "2025-01-09", 8, 9).collect()
    assert backfill.walked(accounts, table, "2025-01-01", "2025-01-09", 8, 10).count() == 2
    assert backfill.walked(accounts, table, "2025-01-10", "2025-01-09", 8, 10).count() == 0
