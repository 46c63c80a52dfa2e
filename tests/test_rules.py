"""Rules as data, their words, and texts that hold other texts."""

import random
import re
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.operators import enrich, rulebook

PATTERNS = ["rewe|edeka|aldi", r"acme\s*gmbh.*gehalt", "(?i)Netto", "([", "a.c", "x*", "", "(?:ab|cd)+e", "(ab)?cd", "[ab]cd", "[^a]bc", "(?=foo)f", "(?P<n>netflix)", r"\bkino\b", "k[iı]no", "straße", "a{0}bc", "(?!ab)cd", "(?:aa|ab|ac|ad)(?:aa|ab|ac|ad|ae)", "^ab$", "(?x) a b", "ab(?-i:CD)", "(?>ab)cd", "ab(c|)d", r"(a)(b)\2\1", "K", "ſs"]


def first(patterns, text):
    for k, p in enumerate(patterns):
        try:
            if re.search(p, text, re.IGNORECASE):
                return k
        except re.error:
            continue
    return -1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PATTERNS), max_size=6), st.text(alphabet="abcdefxkinoſıİKst  Cß", max_size=24))
def test_first_match_is_that_of_a_plain_search(patterns, text):
    for t in (text, text.lower()):
        assert rulebook.Matcher(tuple(patterns)).first(t) == first(patterns, t)


@pytest.mark.parametrize("text", ["REWE Markt", "acme  gmbh mai gehalt", "NETFLIX.com", "ab cd", "kıno", "KINO", "abe cde", "aaae", "Straße", "", "K"])
def test_every_pattern_alone(text):
    for p in PATTERNS:
        assert rulebook.Matcher((p,)).first(text) == first([p], text), p


def test_words_of_patterns():
    assert rulebook.needed("rewe|edeka|aldi") == [{"rewe", "edeka", "aldi"}]
    assert rulebook.needed(r"acme\s*gmbh.*gehalt") == [{"acme"}, {"gmbh"}, {"gehalt"}]
    assert rulebook.needed("(?:17|18)x") == [{"17x", "18x"}] and rulebook.needed("x*|y") == rulebook.needed("a?b?") == []
    rules = rulebook.Matcher(tuple(f"customer#0*{k}" for k in range(10, 2000)))
    assert rules.first("customer#0000001234 a") == 2 and len(rules.compiled) < 20  # of 1990: few are tried


def ledger(spark, texts):
    return spark.createDataFrame([(str(k), None, t, "", c) for k, (t, c) in enumerate(texts)], "id string, sender string, recipient string, description string, category_id string")


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([("netto", "food", 1, "b"), ("ne", "ne", 1, "a"), ("([", "bad", 9, "c"), (None, "none", 9, "d"), ("(?P<x>t)t", "tt", 5, "e"), ("zz", None, 9, "f")], "pattern string, category_id string, priority int, rule_id string")
    rows = ledger(spark, [("Netto", None), ("nerd", None), (None, None), ("xx", "kept"), ("zz netto", "kept")])
    got = {r["id"]: (r["matched"], r["category_id"]) for r in rulebook.apply_rules(rows, rules).collect()}
    assert got == {"0": ("tt", "tt"), "1": ("ne", "ne"), "2": (None, None), "3": (None, "kept"), "4": (None, "kept")}
    assert rulebook.apply_rules(rows, rules.where("false")).where("matched is not null").count() == 0


def test_patterns_that_one_engine_refuses(spark):
    """Named groups are read by both; what either refuses matches nothing and stops nothing."""
    rules = [("(?P<n>net)flix(?P=n)", "a", 3), ("(?<=x+)y", "b", 2), ("(?(1)a|b)", "c", 2), ("net", "d", 1)]
    got = [r["matched"] for r in enrich.apply_rules(ledger(spark, [("netflixnet", None), ("xy", None), ("internet", None)]), rules).orderBy("id").collect()]
    assert got == ["a", None, "d"]


def test_containing_equals_a_plain_search(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab") for _ in range(n))
    longer, shorter = [text(r.randrange(2, 14)) for _ in range(120)] + ["same text"] * 3, [text(r.randrange(1, 9)) for _ in range(60)] + ["same", "none of these"]
    got = enrich.containing(spark.createDataFrame([(x,) for x in [*longer, None]], "longer string"), spark.createDataFrame([(x,) for x in [*shorter, None]], "shorter string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a in longer for b in shorter if len(b) >= 4 and b in a})
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_memory_examples_both_ways(spark):
    rows = [(str(k), c, n, None, date(2026, 1, k), Decimal(1)) for k, (c, n) in enumerate([("food", "ACME Shop"), ("food", "acme shop"), ("rent", "Shop"), ("x", "abc"), (None, "acme shop")], 1)]
    history = spark.createDataFrame(rows, "id string, category_id string, recipient string, sender string, booking_date date, amount decimal(14,2)")
    found = lambda *keys: [r["id"] for r in enrich.memory_examples(history, spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert found("ACME") == ["2"] and found("buy at acme shop now") == ["3", "2"] and found("abc", "abcd") == [] and found("shop") == ["3", "2"]


def test_more_rules_than_are_sent_at_once(spark):
    """Rules in chunks find what all of them at once find, in the same order; texts that nothing matches and rows alike stay."""
    r = random.Random(7)
    rules = [("".join(r.choice("abc") for _ in range(r.randrange(2, 5))), f"c{k}", r.choice([None, 1, 2, 3]), f"{k:03d}") for k in range(60)] + [("([", "bad", 9, "x"), (None, "none", 9, "y")]
    table = spark.createDataFrame(rules, "pattern string, category_id string, priority int, rule_id string")
    rows = ledger(spark, [("".join(r.choice("abcd") for _ in range(6)), r.choice([None, "kept"])) for _ in range(80)] + [("zzz", None), ("zzz", None), (None, None)])
    found = [sorted(map(str, rulebook.apply_rules(rows, table, most).select("id", "matched", "category_id").collect())) for most in (1000, 61, 25)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 83
