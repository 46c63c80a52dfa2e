"""The audit of the vector links where copies are rare or one group is large."""

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import vectorgraph


def nodes(spark, x):
    return spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "node long, copies long, v array<double>").withColumn("key", F.sha2(F.col("node").cast("string"), 256))


def pairs_among_singles(singles, pairs):
    r = np.random.default_rng(5)
    x = r.normal(size=(singles, 32))
    return np.concatenate([x, x[:pairs] + 0.01 * r.normal(size=(pairs, 32))])


def test_asks_on_until_links_are_seen(spark):
    x = pairs_among_singles(3000, 40)
    asked, _ = vectorgraph._audit_sample(nodes(spark, x), 100, 0.9, 65_536)
    linked = {k for k, links in asked if links}
    assert len(linked) >= 50 and linked <= set(range(40)) | set(range(3000, 3040)) and all(links == 1 for _, links in asked if links)
    nothing = spark.createDataFrame([], "node long, links long")
    assert vectorgraph._recall(nothing, asked) == 0.0


def test_all_are_asked_where_none_has_links(spark):
    asked, last = vectorgraph._audit_sample(nodes(spark, pairs_among_singles(700, 0)), 100, 0.9, 65_536)
    assert last is None and sorted(asked) == [(k, 0) for k in range(700)]
    assert vectorgraph._recall(spark.createDataFrame([], "node long, links long"), asked) == 1.0


def test_a_large_group_does_not_hide_pairs(spark):
    asked = [(k, 10_000) for k in range(30)] + [(100 + k, 1) for k in range(20)]
    found = spark.createDataFrame([(k, 10_000) for k in range(30)], "node long, links long")
    assert abs(vectorgraph._recall(found, asked) - 0.6) < 1e-9


def test_stops_at_a_stated_number_and_asks_what_was_found(spark):
    x = nodes(spark, pairs_among_singles(900, 1))
    asked, last = vectorgraph._audit_sample(x, 100, 0.9, 300)
    keys = {r["node"]: r["key"] for r in x.select("node", "key").collect()}
    assert len(asked) == 300 and last == sorted(keys.values())[299] == max(keys[k] for k, _ in asked)
    found = spark.createDataFrame([(0, 1), (900, 1), (5, 0)], "node long, links long")
    assert sorted(vectorgraph._audit_found(x, x, found, 100, 0.9)) == [(0, 1), (900, 1)]
    assert vectorgraph._audit_found(x, x, found.where("links > 1"), 100, 0.9) == []


def test_links_are_found_where_the_audit_sees_few(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "CLUSTER", 60)
    x = pairs_among_singles(700, 3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectorgraph.near_duplicates(rows, audit_most=20).collect()}
    assert got == {k: (int(k < 3 or k >= 700), k - 700 if k >= 700 else k) for k in range(703)}


def test_no_links_at_all_ends(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "CLUSTER", 60)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pairs_among_singles(400, 0))], "vec_id long, embedding array<double>")
    assert vectorgraph.near_duplicates(rows, audit_most=20).where("n_links <> 0 or not kept").count() == 0
