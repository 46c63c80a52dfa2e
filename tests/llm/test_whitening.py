"""Whitening against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallyhouse.llm import whitening
from tests.llm.helpers import vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(rows):
    """x-vectors, exact sums and the covariance in fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = [[Fraction(r[k]) - Fraction(sums[k], n) for k in range(d)] for r in x]
    return x, sums, np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])


def compare(got, rows, components):
    x, sums, v = exact(rows)
    n = len(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * components
    white = (np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(r, sums, strict=True)] for r in x]) @ axes[:, :components]) / np.sqrt(values[:components])
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], set()).add((r["whitened"], int(r["deviation"])))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
    assert sorted(by) == list(range(1, components + 1))
    for c, found in by.items():
        sign = np.sign(sum(next(iter(found[i]))[0] * w[c - 1] for (i, _), w in zip(rows, white, strict=True)))
        for (i, _), w, r in zip(rows, white, x, strict=True):
            deviation = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
            assert any(z == deviation and sign * y == pytest.approx(w[c - 1], abs=1e-8) for y, z in found[i])


def test_rows(spark):
    """Vectors that are null, zero, not finite, of another length; repeated ones and one without an id."""
    every = vectors()
    df = spark.createDataFrame(every, SCHEMA).repartition(5)
    fine = [(i, v) for i, v, _ in every if v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v)]
    assert (2200, [0.0] * 16) in fine and None in [i for i, _ in fine]
    compare(whitening.whiten(df).collect(), fine, 8)


def test_large_entries_keep_their_digits(spark):
    """Entries of nearly 2^40 that differ by little: squares that are not centred first would lose all digits."""
    r = np.random.default_rng(1)
    rows = [(k, [float(2**37 + a), float(2**37 - 3 * a + b), float(b) / 64]) for k, (a, b) in enumerate(r.integers(0, 9, (60, 2)).tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), components=2).collect()
    x, sums, v = exact(rows)
    assert max(g["identity_error"] for g in got) < 1e-6
    want = np.linalg.eigvalsh(v)[::-1] / np.trace(v)
    assert sorted({g["explained"] for g in got}, reverse=True) == pytest.approx(list(want[:2]), rel=1e-9)
    deviations = {g["vec_id"]: int(g["deviation"]) for g in got}
    assert deviations == {i: sum((60 * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i, _ in rows}


def test_double_double():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4)) * 1e6 + 1e9
    mean = [sum(map(Fraction, c)) / 500 for c in x.T.tolist()]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high, strict=True)])
    half = [whitening.outer(part, high, low) for part in (x[:200], x[200:])]
    total = whitening.added(*half)
    y = [[Fraction(a) - m for a, m in zip(row, mean, strict=True)] for row in x.tolist()]
    for i in range(4):
        for j in range(4):
            want = sum(a[i] * a[j] for a in y)
            assert abs(Fraction(total[0][i, j]) + Fraction(total[1][i, j]) - want) < abs(want) * Fraction(1, 2**70) + Fraction(1, 2**20)


def test_few_or_equal_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(df([])).count() == 0
    assert whitening.whiten(df([(1, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whiten(df([(k, [1.0, 2.0], 0) for k in range(9)])).count() == 0
    one = whitening.whiten(df([(k, [float(k), 2.0], 0) for k in range(3)]), components=8).collect()
    assert {r["component"] for r in one} == {1} and sorted(abs(r["whitened"]) for r in one) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    assert whitening.whiten(df([(1, [1e30, 1.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 4.0], 0)])).count() == 2
