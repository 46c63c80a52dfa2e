"""Tables of one or two clusters: no link is lost untold."""

import logging

import numpy as np

from tallyhouse.llm import vectorgraph
from tests.llm.test_clusters import truth
from tests.llm.test_similar import components, frame


def test_borderline_groups_of_a_small_table(spark, caplog):
    r = np.random.default_rng(6)
    x = np.concatenate([c + 0.28 * r.normal(size=(10, 24)) for c in r.normal(size=(300, 24))]).astype(np.float32).astype(float)
    near = truth(x)
    with caplog.at_level(logging.INFO):
        got = {k["vec_id"]: (k["n_links"], k["component_id"]) for k in vectorgraph.near_duplicates(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])).collect()}
    assert near.sum() > 5000 and [got[k][0] for k in range(3000)] == near.sum(axis=1).tolist()
    comp = components(list(range(3000)), [tuple(map(int, p)) for p in np.argwhere(near)])
    assert [got[k][1] for k in range(3000)] == [comp[k] for k in range(3000)]
    assert "recall 1.0000 over 3000 audited vectors" in caplog.text


def test_what_a_narrow_search_misses_is_searched_for_again(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "SLACK", 0.0)
    monkeypatch.setattr(vectorgraph, "NEAR", 2)
    monkeypatch.setattr(vectorgraph, "RANDOM", 1)
    slack = []
    search = vectorgraph._search

    def narrow(*a):
        slack.append(a[-1])
        return search(*a[:-1], a[-1] or 1e-3)

    monkeypatch.setattr(vectorgraph, "_search", narrow)
    monkeypatch.setattr(vectorgraph, "SLACK", 0.001)
    r = np.random.default_rng(8)
    x = np.concatenate([c + 0.3 * r.normal(size=(12, 16)) for c in r.normal(size=(40, 16))])
    got = {k["vec_id"]: k["n_links"] for k in vectorgraph.near_duplicates(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])).collect()}
    assert [got[k] for k in range(480)] == truth(x).sum(axis=1).tolist() and len(slack) > 1 and slack == sorted(slack)
