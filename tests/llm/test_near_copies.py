"""Nearest neighbours in a group of close but unequal copies much larger than what is reranked first."""

import numpy as np

from tallyhouse.llm import neighbours
from tests.llm.test_similar import frame


def test_large_group_of_near_copies(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=16) + 0.001 * r.normal(size=(1500, 16)), r.normal(size=(500, 16))]).astype(np.float32).astype(float)
    got = {}
    for row in neighbours.search(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)]), lambda i: i % 100 == 0, k=10).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(got) == list(range(0, 2000, 100))
    for q, rows in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(len(x)), far))[:10]
        assert [i for _, i, _ in sorted(rows)] == want.tolist()
        assert np.allclose([s for _, _, s in sorted(rows)], far[want], rtol=0, atol=1e-12)


def brute(x, q, k=10):
    far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    far[q] = np.inf
    best = np.lexsort((np.arange(len(x)), far))[:k]
    return best.tolist(), far[best]


def test_cells_are_met_until_the_audit_is_content(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 60)
    monkeypatch.setattr(neighbours, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([centres[r.integers(0, 12, 1300)] + 0.4 * r.normal(size=(1300, 16)), r.normal(size=(500, 16))]).astype(np.float32).astype(float)
    rows = frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    met = []
    inner = neighbours._in_cells
    monkeypatch.setattr(neighbours, "_in_cells", lambda rows, centres, n: met.append(n) or inner(rows, centres, n))

    def recall(**more):
        met.clear()
        got = {}
        for row in neighbours.search(rows, lambda i: i % 20 == 0, k=10, **more).collect():
            got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
        assert sorted(got) == list(range(0, 1800, 20)) and all([k for k, *_ in sorted(g)] == list(range(1, 11)) for g in got.values())
        for q, g in got.items():
            assert np.allclose([s for *_, s in sorted(g)], [np.sqrt(((x[i] - x[q]) ** 2).sum()) for _, i, _ in sorted(g)], rtol=0, atol=1e-12)
        return np.mean([len({i for _, i, _ in g} & set(brute(x, q)[0])) / 10 for q, g in got.items()])

    monkeypatch.setattr(neighbours, "PROBES", 1)
    low = recall(recall=0.0)
    assert met == [1, 1] and low < 0.95
    assert recall(recall=0.95) >= 0.93 and len(met) > 2  # widened
    assert recall(recall=1.1) == 1.0 and met[-1] == 30  # exact: every cell


def test_an_id_that_asks_twice_asks_once(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [0.0, 2.0], 0), (2, [3.0, 0.0], 0)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(frame(spark, rows), lambda i: i == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, float(np.sqrt(10)))]
