"""Versions put into a store, and how often what is stored is shuffled for them; streams whose state is asked once a hash."""

import pandas as pd

from tallyhouse.operators import incremental, versions
from tallyhouse.sources.folders import fresh_folder, stored
from tallyhouse.sources.store import Store
from tallyhouse.streaming.chains import _Chain

SCHEMA = "source string, external_id string, content_hash string, arrival int"


def test_extended_as_inserted(spark):
    first = versions.versions(spark.createDataFrame([("s", "x", "h1", 1), ("s", "x", "h2", 2), (None, "x", "n1", 3), ("s", None, "b1", 4), ("s", "y", "g1", 5)], SCHEMA))
    later = spark.createDataFrame([("s", "x", "h3", 6), ("s", "x", "h4", 7), (None, "x", "n2", 8), ("s", None, "b2", 9), ("s", "z", "k1", 10)], SCHEMA)
    got = versions.extended(stored(first, "first"), stored(versions.versions(later), "later"))
    want = versions.insert_versions(first, later)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_stored_versions_are_shuffled_once(spark, monkeypatch):
    plans, store = [], Store(spark, fresh_folder(spark, "store"), 2)
    commit = Store.commit
    monkeypatch.setattr(Store, "commit", lambda self, name, changes: plans.append(changes) or commit(self, name, changes))
    for k in range(2):
        incremental.insert_versions(store, spark.createDataFrame([("s", "x", f"h{k}", k)], SCHEMA), str(k))
    plan = plans[1]["versions"].rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") <= 1


class _State:
    def __init__(self):
        self.asked, self.held = 0, {}

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.held

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def exists(self):
        return False

    def update(self, value):
        pass


def test_state_is_asked_once_a_hash():
    chain = _Chain()
    chain.newest, chain.known = _State(), _State()
    frames = [pd.DataFrame({"content_hash": ["b", "a", "b"], "arrival": [3, 2, 9]}), pd.DataFrame({"content_hash": ["b", "a"], "arrival": [1, 5]})]
    out = pd.concat(chain.handleInputRows(("s", "x"), iter(frames), None))
    assert out[["content_hash", "arrival", "version"]].values.tolist() == [["b", 1, 1], ["a", 2, 2]] and chain.known.asked == 2
