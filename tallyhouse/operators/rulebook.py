"""Rules by the thousand: which of them matches a text first.

A pattern is read for words that each of its matches must hold one of. All words of all rules make one automaton, which a
text is run through once; only rules whose words occur, and those that need none, are tried, in order. A row costs its
length and the few rules it may match, however many rules there are. More rules than a task should hold are dealt by their
words (see ``rulewords``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import haystack
from tallyhouse.operators.ordering import numbered
from tallyhouse.operators.rulewords import ALIKE, EDGE, compiled, first_by_words, needed, rule_words
from tallyhouse.sources.folders import stored

#: Rules that are sent to the tasks at once; texts whose rule a task remembers.
MOST_RULES, REMEMBERED = 200_000, 50_000


class Matcher:
    """The first of ``patterns``, as they are ordered, that is found in a text. Those that do not compile match nothing."""

    def __init__(self, patterns: tuple[str, ...]):
        import ahocorasick

        self.patterns, self.compiled = patterns, {}
        self.always: list[int] = []
        sets: dict[int, list[set[str]]] = {}
        for k, p in enumerate(patterns):
            with suppress(re.error, OverflowError, RecursionError):
                sets[k] = [{word.rstrip(EDGE) for word in some} for some in needed(p)]
        shared = Counter(word for own in sets.values() for word in set().union(*own))
        words: dict[str, list[int]] = {}
        for k, own in sets.items():  # the words that fewest rules share tell most
            for word in min(own, key=lambda some: (max(shared[w] for w in some), -min(map(len, some))), default=()):
                words.setdefault(word, []).append(k)
            if not own:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for word, rules in words.items():
            self.automaton.add_word(word, rules)
        if words:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def _found(self, k: int, text: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = compiled(self.patterns[k])
        return self.compiled[k] is not None and self.compiled[k].search(text) is not None

    def first(self, text: str) -> int:
        """The rule's place, or -1."""
        place = self.known.get(text)
        if place is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            candidates = set(self.always)
            if len(self.automaton):
                for _, rules in self.automaton.iter(text.translate(ALIKE).lower()):
                    candidates.update(rules)
            place = self.known[text] = next((k for k in sorted(candidates) if self._found(k, text)), -1)
        return place


@lru_cache(maxsize=2)
def _matcher(patterns: tuple[str, ...]) -> Matcher:
    return Matcher(patterns)


def first_match(text: Column, patterns: list[str]) -> Column:
    """The place of the first pattern that a text holds, from 0; null if none or if the text is null."""
    kept = tuple(patterns)

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(kept)
        for texts in batches:
            found = [None if t is None else matcher.first(t) for t in texts]
            yield pd.Series([None if k is None or k < 0 else k for k in found], dtype="Int32")

    return F.pandas_udf(places, "int")(text)


def placed(rules: DataFrame) -> DataFrame:
    """pattern, category_id, _place of ``rules`` (pattern, category_id, priority, rule_id), stored: places from 1, highest priority first, then by rule_id; rules without a pattern are left out."""
    kept = rules.where("pattern is not null").select("pattern", "category_id", "priority", "rule_id", F.lit(0).alias("_all"))
    return stored(numbered(kept, ["_all"], [F.desc_nulls_last("priority"), "rule_id"], "_place").select("pattern", "category_id", "_place"), "rules")


def chunks(rules: DataFrame, most: int = MOST_RULES) -> Iterator[list[tuple[int, str, str]]]:
    """(_place, pattern, category_id) of ``rules`` (see ``placed``) in order, at most ``most`` at a time. They are numbered over ranges, so the driver holds one chunk."""
    lines = stored(numbered(rules.select("pattern", "category_id", "_place", F.lit(0).alias("_all")), ["_all"], ["_place"], "_line"), "lines")
    for begin in range(0, lines.agg(F.coalesce(F.max("_line"), F.lit(0))).first()[0], most):
        rows = lines.where(F.col("_line").between(begin + 1, begin + most)).collect()
        yield [(r["_place"], r["pattern"], r["category_id"]) for r in sorted(rows, key=lambda r: r["_line"])]


def _chosen(rows: DataFrame, text: Column, kept: list[tuple[int, str, str]]) -> DataFrame:
    """``rows`` with the first of the rules ``kept`` that ``text`` matches: its ``_own`` place and ``_category``, null if there is none."""
    categories = rows.sparkSession.createDataFrame([(k, p, c) for k, (p, _, c) in enumerate(kept)], "_rule int, _own long, _category string")
    return rows.withColumn("_rule", first_match(text, [p for _, p, _ in kept])).join(F.broadcast(categories), "_rule", "left").drop("_rule")  # a chunk at most


def _met(texts: DataFrame, found: DataFrame, loose: DataFrame, most: int) -> DataFrame:
    """``found`` (_text, _place, matched) of ``texts``, where none of the ``loose`` rules comes before; these meet, chunk after chunk, the texts that no rule before theirs matches."""
    left, done = stored(texts.join(found, "_text", "left"), "left"), []
    for kept in chunks(loose, most):
        open_ = F.col("_place").isNull() | (F.col("_place") > kept[0][0])
        done.append(left.where(~open_))
        earlier = F.col("_own") < F.coalesce("_place", F.col("_own") + 1)
        tried = _chosen(left.where(open_), F.col("_text"), kept)
        left = stored(tried.select("_text", F.when(earlier, F.col("_own")).otherwise(F.col("_place")).alias("_place"), F.when(earlier, F.col("_category")).otherwise(F.col("matched")).alias("matched")), "left")
    return reduce(DataFrame.unionByName, [*done, left.where("_place is not null")])


def apply_rules(ledger: DataFrame, rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """``ledger`` with ``matched``, the category of the first of ``rules`` (see ``placed``) that a row's text matches, which fills missing categories only.

    Up to ``most`` rules are sent to the tasks at once. If there are more, each text is taken once and meets the rules
    whose words it holds, by a join; rules that have no word of their own are sent to the texts chunk after chunk.
    """
    text, rules = haystack(F.col("sender"), F.col("recipient"), F.col("description")), placed(rules)
    n = rules.agg(F.coalesce(F.max("_place"), F.lit(0))).first()[0]
    if not n:
        matched = ledger.withColumn("matched", F.lit(None).cast("string"))
    elif n <= most:
        kept = [(r["_place"], r["pattern"], r["category_id"]) for r in sorted(rules.collect(), key=lambda r: r["_place"])]
        matched = _chosen(ledger, text, kept).drop("_own").withColumnRenamed("_category", "matched")
    else:
        words, texts = rule_words(rules), ledger.select(text.alias("_text")).distinct()
        loose = words.where("_key is null")
        found = first_by_words(texts, words)
        if not loose.isEmpty():
            found = _met(texts, found, loose, most)
        matched = ledger.withColumn("_text", text).join(found.drop("_place"), "_text", "left").drop("_text")
    return matched.withColumn("category_id", F.coalesce("category_id", "matched"))
