"""The vector graph over many clusters and shards, with constants lowered so that small tables have them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import vectorgraph
from tests.llm.test_similar import components, frame


def groups(n_groups, size, d=24, noise=0.25, singles=600, seed=4):
    """Groups of copies whose spread makes some pairs fall short of the threshold, and vectors of no group."""
    r = np.random.default_rng(seed)
    x = [c + noise * r.normal(size=(int(r.integers(2, size)), d)) for c in r.normal(size=(n_groups, d))]
    return np.concatenate([*x, r.normal(size=(singles, d))]).astype(np.float32).astype(float)


def truth(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("CLUSTER", 60), ("SHARD", 50), ("QUERIES", 40)):
        monkeypatch.setattr(vectorgraph, name, value)


@pytest.mark.parametrize("most", [4096, 5])
def test_many_clusters(spark, small, monkeypatch, most):
    monkeypatch.setattr(vectorgraph, "MOST_CLUSTERS", most)  # 5: clusters are cut again
    x = groups(70, 30)
    near = truth(x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectorgraph.near_duplicates(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])).collect()}
    links = np.array([got[k][0] for k in range(len(x))])
    assert len(x) > 20 * 60 and near.sum() > 5000
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    comp = components(list(range(len(x))), [tuple(map(int, p)) for p in np.argwhere(near)])
    assert np.mean([got[k][1] == comp[k] for k in range(len(x))]) >= 0.99


def test_both_ends_count_a_pair(spark, small):
    # the copies of a node are a power of two of its own, so that its links tell which nodes they are
    x = groups(6, 9, singles=0, noise=0.3, seed=9)[:40]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(k, 1 << k, v.tolist()) for k, v in enumerate(x)], "node long, copies long, v array<double>")
    for n_centres in (1, 4, 8):
        centres = x[np.linspace(0, len(x) - 1, n_centres).astype(int)]
        links, _ = vectorgraph._search(nodes, centres, min(2, n_centres), 0.85)
        met = {r["node"]: r["links"] for r in links.collect()}
        pairs = {(a, b) for a in met for b in range(len(x)) if met[a] >> b & 1}
        assert pairs == {(b, a) for a, b in pairs} and all(a != b for a, b in pairs)
        want = {tuple(map(int, p)) for p in np.argwhere(truth(x, 0.85))}
        assert pairs <= want and len(pairs) >= 0.95 * len(want) > 0


def test_the_search_leaves_a_cluster_through_the_lists(spark):
    # a row of vectors, each in range of its neighbours alone, cut by two centres: links across the cut are found although data lie in one cluster each
    angles = np.arange(24) * 0.4
    x = np.stack([np.cos(angles), np.sin(angles), 0.0 * angles], axis=1)[:7]
    nodes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "node long, copies long, v array<double>")
    links, edges = vectorgraph._search(nodes, x[[1, 5]], 2, 0.9)
    assert {r["node"]: r["links"] for r in links.collect()} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}
    comp = {r["id"]: r["component"] for r in vectorgraph.components(edges).collect()}
    assert set(comp.values()) == {0}
    assert edges.where(F.col("a") == F.col("b")).count() == 0
