"""Stored tables: what a batch touches, what it leaves alone, and what a reader sees meanwhile."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import incremental, versions
from tallyhouse.sources.folders import fresh_folder
from tallyhouse.sources.store import MOST_FOLDERS, Change, Store


@pytest.fixture
def store(spark):
    return Store(spark, fresh_folder(spark, "store"), 8)


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def held(store, name="t"):
    return sorted(map(tuple, store.read(name).collect()), key=str)


def folders(store, name="t"):
    return {b: x["folders"] for b, x in store.manifest()["tables"][name]["buckets"].items()}


def test_untouched_buckets_keep_their_files(spark, store):
    incremental.upsert(store, "t", table(spark, [(k, "a") for k in range(40)] + [(None, "n")]), ["k"], "1")
    before = folders(store)
    touched = store.touched(table(spark, [(3, ""), (50, "")]), ["k"])
    incremental.upsert(store, "t", table(spark, [(3, "b"), (50, "b")]), ["k"], "2")
    now = folders(store)
    assert {int(b) for b in now if now[b] != before.get(b)} == set(touched) and 0 < len(touched) < len(now)
    assert held(store) == sorted([(k, "b" if k in (3, 50) else "a") for k in [*range(40), 50]] + [(None, "n")], key=str)
    assert store.vacuum() == len(touched) and len(held(store)) == 42


def test_replays_change_nothing(spark, store):
    rows = table(spark, [(k, "a") for k in range(20)])
    incremental.upsert(store, "t", rows, ["k"], "1")
    before, number = folders(store), store.manifest()["number"]
    incremental.upsert(store, "t", rows, ["k"], "1")
    assert store.manifest()["number"] == number  # the name is known
    incremental.upsert(store, "t", rows, ["k"], "other")
    assert folders(store) == before  # the rows are as they were
    incremental.upsert(store, "t", rows.where("false"), ["k"], "none")
    assert folders(store) == before and len(held(store)) == 20


def test_half_a_batch_is_never_seen(spark, store):
    store.commit("1", {"t": Change(table(spark, [(1, "a")]), ["k"]), "u": Change(table(spark, [(9, "z")]), ["k"])})
    reader = store.read("t")
    bad = table(spark, [(1, "x")]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit("2", {"u": Change(table(spark, [(9, "new")]), ["k"], store.touched(table(spark, [(9, "")]), ["k"])), "t": Change(bad, ["k"])})
    assert held(store) == [(1, "a")] and held(store, "u") == [(9, "z")]
    store.commit("2", {"t": Change(table(spark, [(1, "b")]), ["k"], store.touched(reader, ["k"]))})
    assert reader.collect() == [(1, "a")] and held(store) == [(1, "b")]
    stale = store.manifest() | {"number": 2}
    with pytest.raises(RuntimeError, match="another writer"):
        store._put(stale)


def test_growing_tables_are_written_anew_now_and_then(spark, store):
    for k in range(MOST_FOLDERS + 3):
        store.commit(str(k), {"t": Change(table(spark, [(1, str(k))]), ["k"])})
    assert len(held(store)) == MOST_FOLDERS + 3 and max(map(len, folders(store).values())) < MOST_FOLDERS
    store.commit("gone", {"t": Change(table(spark, []), ["k"], list(range(8)))})
    assert held(store) == [] and store.read("never") is None


def test_versions_in_batches(spark, store):
    rows = spark.createDataFrame([("s", "x", "h1", 1), ("s", "x", "h2", 2), ("s", "x", "h1", 3), ("s", None, "h3", 4), ("t", "y", "h2", 5), ("s", "x", "h5", 6)], "source string, external_id string, content_hash string, arrival int")
    for k, part in enumerate(("arrival = 1", "arrival in (2, 3)", "arrival > 3", "arrival < 6")):
        incremental.insert_versions(store, rows.where(part), str(k))
    assert sorted(map(tuple, store.read("versions").collect()), key=str) == sorted(map(tuple, versions.versions(rows).select(store.read("versions").columns).collect()), key=str)


def test_evidence_in_batches(spark, store):
    kind = "evidence_id string, source string, order_ref_hash string, evidence_type string, total_amount int, seq int"
    batches = [[("a", "g", "h1", "order", 1, 1), ("b", "g", None, "order", 2, 2)], [("x", "g", "h1", "order", 10, 1), ("b", "g", "h9", "order", 20, 2)], [("y", "g", "h9", "order", 30, 1), ("z", "g", None, "order", 40, 2)]]
    for k, rows in enumerate(batches):
        incremental.upsert_evidence(store, spark.createDataFrame(rows, kind), "seq", str(k))
    got = {r["evidence_id"]: (r["order_ref_hash"], r["total_amount"]) for r in store.read("evidence").collect()}
    assert got == {"a": ("h1", 10), "b": ("h9", 30), "z": (None, 40)}
