"""More rules than are sent at once: dealt by their words, told by either engine, in the order of all."""

import random
import re
from contextlib import suppress

import pytest

from tallyhouse.operators import rulebook, rulewords

ATOMS = ["a", "b", "1", "2", "12", "0", " ", "#", r"\b", r"\d", r"\w", r"\s", r"\S", ".", "^", "$", "[12]", "[1-3]", "[^1a]", "[a-c1]", "[X-b]", "[^Z-c]", r"[\d ]", "(?:12|13)", "(1|2)", "(?P<n1>1|a)", "a*", "0*", "1+", "[12]*", "[ab]+?", "(?:ab|1)*", "1{2}", "2{0,3}", "(?=.*1)", "(?!2)", "(?<=1)", r"\1", "(?:|1)", "k", "s", "i", "é", r"\.", r"\x31", r"\Z", "(?-i:a)", r"(?a:\w)", "S", r"\B", "1*", "(", "|"]


def made(seed, n):
    """Patterns that compile, each with what is read of it and a text."""
    r = random.Random(seed)
    while n:
        pattern = "".join(r.choice(ATOMS) for _ in range(r.randrange(1, 6)))
        with suppress(re.error):
            yield pattern, re.compile(pattern, re.IGNORECASE), rulewords.parted(rulewords.read_rule(pattern)), "".join(r.choice("ab12 0#kKsSſıİiAé\n.\x1c_3c") for _ in range(r.randrange(9)))
            n -= 1


def test_a_text_that_matches_holds_a_word_of_each_set():
    for pattern, compiled, (plain, sets), text in made(1, 20_000):
        found = compiled.search(text) is not None
        assert plain is None or (re.search(plain, text, re.IGNORECASE) is not None) == found, (pattern, plain, text)
        folded = text.translate(rulewords.ALIKE).lower()
        held = lambda word: word in folded if not word.endswith(rulewords.EDGE) else re.search(re.escape(word[:-1]) + "(?![A-Za-z0-9_])", folded)  # noqa: E731, B023
        assert not found or all(any(map(held, some)) for some in sets), (pattern, sets, text)


def test_both_engines_read_the_shared_pattern_alike(spark):
    rows = [(plain, text, compiled.search(text) is not None) for _, compiled, (plain, _), text in made(2, 20_000) if plain is not None and text.isascii()]
    assert len(rows) > 4000 and sum(hit for *_, hit in rows) > 1000
    wrong = spark.createDataFrame(rows, "pattern string, text string, hit boolean").where("hit != (text rlike concat('(?i)', pattern))")
    assert wrong.collect() == []


def test_words_of_rules():
    assert rulewords.needed(r"customer#0*(?:120|121)\b") == [{"customer#"}, {"#120\b", "#121\b", "0120\b", "0121\b"}]
    assert rulewords.needed("#0*7 +(?P<l>1-x|2-y) ") == [{"#7 ", "07 "}, {" 1-x ", " 2-y "}]
    assert rulewords.needed("(?=.*wood)^ *a*[12]0 ") == [{"wood"}, {"10 ", "20 "}]
    assert rulewords.needed(r"(?a)ab\b") == [{"ab"}] and rulewords.needed(r"a?\bb") == []
    for pattern in (r"a{12}", r"x[1-5]y", r"(?P<n2>12)x", r"(1)\1", "[5-1]"):  # digits that are no letters
        with suppress(re.error):
            assert rulewords.read_rule(pattern) == rulewords._read_rule(pattern)
    with pytest.raises(re.error):
        rulewords.read_rule("[5-1]")


def test_keys_of_words_are_found_in_texts_however_they_are_cut(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(rulewords, "PIECE", 64)
    rulewords._powers.cache_clear()
    r = random.Random(3)
    texts = ["".join(r.choice("ab1 K") for _ in range(r.choice([0, 1, 5, 40, 200]))) for _ in range(60)] + ["", "ſab", "ab"]
    words = sorted({"".join(r.choice("ab1 ") for _ in range(r.randrange(2, 30))) for _ in range(200)} | {"ab" + rulewords.EDGE, "sa", "b1" + rulewords.EDGE})
    cut = list(map(rulewords._cut, words))
    keys, lengths = rulewords.word_keys(cut), np.zeros(1 << 21, np.uint64)
    for stem, bits in zip(*map(np.ndarray.tolist, rulewords.word_stems(cut)), strict=True):
        lengths[stem if stem >= 0 else slice((-1 - stem) << 7, -stem << 7)] |= np.uint64(bits)
    known = np.full(1 << rulewords.FILTER_BITS - 6, (1 << 64) - 1, np.uint64)
    text, key = rulewords._found(*rulewords._letters_of(pa.array(texts, pa.large_string())), lengths, known)
    rulewords._powers.cache_clear()
    got, of = set(zip(text.tolist(), key.tolist(), strict=True)), dict(zip(cut, keys.tolist(), strict=True))
    folded = [t.translate(rulewords.ALIKE).lower() for t in texts]
    want = {(k, of[w]) for k, t in enumerate(folded) for w in cut if (w in t if not w.endswith(rulewords.EDGE) else re.search(re.escape(w[:-1]) + "(?![a-z0-9_])", t))}
    assert {x for x in got if x[1] in of.values()} == want and len(text) == len(got)


def test_rules_dealt_by_words_and_rules_without(spark, monkeypatch):
    """Rules that share their words, or have none, stand between rules of own words; the first in order counts, whichever way it was met."""
    monkeypatch.setattr(rulewords, "MOST_SHARING", 3)
    r = random.Random(11)
    patterns = [f"shop{k}\\b" for k in range(30)] + [f"market.*{k}" for k in range(9)] + ["z", "a.b", "(?<=x+)y", "([", "straße", "(?:ab)+c", r"\bkino\b", "x[é]y"] + [f"no 0*(?:{k}|{k + 1})\\b" for k in range(0, 40, 3)]
    rules = [(p, None if k % 17 == 5 else f"c{k}", r.choice([None, 1, 2]), k) for k, p in enumerate(patterns)]
    r.shuffle(rules)
    words = ["shop1", "shop12", "Shop3", "market 4", "zz", "a_b", "STRASSE", "Straße", "ababc", "KINO", "kınos", "xéy", "no 007", "no 12", "no 123", "xxy", "", " "]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(150)] + [None]
    ledger = spark.createDataFrame([(str(k), None, t, "", r.choice([None, "kept"])) for k, t in enumerate(texts)], "id string, sender string, recipient string, description string, category_id string")
    table = spark.createDataFrame(rules, "pattern string, category_id string, priority int, rule_id int")
    ordered = sorted(rules, key=lambda x: (-(x[2] or 0), x[3]))
    before = {row["id"]: (row["t"], row["category_id"]) for row in ledger.selectExpr("id", "lower(concat_ws(' ', '', coalesce(recipient, ''), description)) AS t", "category_id").collect()}
    for most in (1000, 20, 3):
        for row in rulebook.apply_rules(ledger, table, most).collect():
            text, category = before[row["id"]]
            matched = next((c for p, c, _, _ in ordered if (it := rulewords.compiled(p)) and it.search(text)), None)
            assert (row["matched"], row["category_id"]) == (matched, category or matched), (most, row)


def test_texts_do_not_meet_chunks_of_rules_that_have_words(spark, monkeypatch):
    """Before, each text met all rules, chunk after chunk: time grew with texts times rules."""
    monkeypatch.setattr(rulebook, "first_match", lambda *_: pytest.fail("a chunk of rules was sent"))
    table = spark.range(3000).selectExpr("concat('customer#0*(?:', id, ')\\\\b') AS pattern", "concat('c', id) AS category_id", "1 AS priority", "id AS rule_id")
    rows = spark.range(200).selectExpr("cast(id AS string) AS id", "'' AS sender", "concat('Customer#', lpad(id * 20, 9, '0')) AS recipient", "'x' AS description", "cast(null AS string) AS category_id")
    assert {(r["id"], r["matched"]) for r in rulebook.apply_rules(rows, table, 1000).collect()} == {(str(k), f"c{k * 20}" if k * 20 < 3000 else None) for k in range(200)}
