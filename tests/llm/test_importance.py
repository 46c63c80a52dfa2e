"""The exact draw against a plain one over all rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tallyhouse.llm import importance, shards
from tests.llm.helpers import documents, texts, words


def runs_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[k : k + n]) for n in (1, 2, 3) for k in range(len(found) - n + 1)]


def brute(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    corpus = Counter(bucket(f) for _, t in rows for f in runs_of(t)[1])
    wanted = Counter(bucket(f) for t in target for f in runs_of(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000))))
    out, able = [], []
    for i, text in rows:
        found, features = runs_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        row = (i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
        (able if len(found) >= least and i is not None else out).append(row)
    able.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    draw = percent * len(able) // 100
    return sorted([(*r, None) for r in out] + [(*r, k + 1 if k < draw else None) for k, r in enumerate(able)], key=str)


def table():
    r = random.Random(4)
    rows = texts() + [(2000 + k, words(r.randrange(5, 60), k)) for k in range(300)] + [(5000, words(40, 1))] * 30
    return rows + [(3000, "ÄÖ äö ÀB́ 日本 x" * 9), (3001, "_" * 50), (3002, "İ K ſ " * 30), (3003, "a\u0000b\x7fc{d|e " * 20)]


TARGET = [words(80, 9), None, "", words(300, 1), "日本 x ÄÖ"]


@pytest.mark.parametrize(("percent", "at_once"), [(5, 1 << 16), (40, 7), (100, 64), (0, 50)])
def test_draw(spark, monkeypatch, percent, at_once):
    """Small blocks and ranges, so that texts and the draw go over several."""
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 16)
    rows = table()
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resample(documents(spark, rows).repartition(7), target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, TARGET, percent, 20)


def test_ranges_cut_again_and_a_hot_score(spark, monkeypatch):
    """More ranges than the driver takes bounds for, and a third of the rows with one score and one id."""
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 4)
    monkeypatch.setattr(importance, "MOST_BOUNDS", 5)
    monkeypatch.setattr(shards, "MOST_BOUNDS", 5)
    r = random.Random(8)
    rows = [(k, 10, r.randrange(50), r.randrange(50)) for k in range(200)] + [(7, 10, 30, 45)] * 100 + [(None, 1, 99, 99)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    got = [tuple(x) for x in importance.drawn(scored, importance.F.lit(True), 50).collect()]
    able = sorted((x for x in rows if x[0] is not None), key=lambda x: (-x[3], x[0], x[1], x[2]))
    want = [(*x, k + 1 if k < 150 else None) for k, x in enumerate(able)] + [(None, 1, 99, 99, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tournament():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted((r.randrange(20), j) for _ in range(r.randrange(9))) for j in range(k)]
        assert list(importance.Tournament(runs)) == sorted(x for run in runs for x in run)


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, []), none).count() == 0
    one = importance.resample(documents(spark, [(1, None)]), none).collect()
    assert [tuple(x) for x in one][0][:3] == (1, 0, 0)
