"""A cluster with many more queries than fit beside a shard."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tallyhouse.llm import vectorgraph
from tests.llm.test_similar import frame


def test_queries_are_read_a_batch_at_a_time():
    r = np.random.default_rng(1)
    v = vectorgraph._unit(r.normal(size=8) + 0.01 * r.normal(size=(60, 8)))
    taken = []

    def batch(role, ids):
        taken.append(len(ids))
        n = len(ids)
        entries = np.zeros(20, vectorgraph.ENTRY)
        entries["id"], entries["cosine"] = range(20), 1
        lists = [[entries.tobytes()] if role == 0 else []] * n
        schema = pa.schema([(k, pa.int64()) for k in ("cluster", "shard", "block", "role", "node", "home", "copies")] + [("v", pa.binary()), ("around", pa.list_(pa.binary())), ("before", pa.list_(pa.int32())), ("now", pa.list_(pa.int32()))])
        return pa.RecordBatch.from_pydict({"cluster": [0] * n, "shard": [0] * n, "block": [0] * n, "role": [role] * n, "node": ids, "home": [0] * n, "copies": [1] * n, "v": [v[i].tobytes() for i in ids], "around": lists, "before": [[]] * n, "now": [[0]] * n}, schema)

    def batches():
        yield batch(0, list(range(20)))
        for k in range(0, 60, 10):
            yield batch(1, list(range(k, k + 10)))

    found = vectorgraph.find_links(batches(), 0.9)
    first = next(found)
    assert taken == [20, 10]  # the first answer needs one batch of queries, not all
    rows = first.to_pylist() + [x for b in found for x in b.to_pylist()]
    links = Counter()
    for x in rows:
        links[x["node"]] += x["links"] or 0
    # queries of this cluster that are in other shards count only what has a larger id: nothing here
    assert links == Counter({i: 19 for i in range(20)})
    assert {x["node"] for x in rows if x["root"] is not None} >= set(range(1, 60)) and len([x for x in rows if x["root"] is not None]) <= 40 + 19


def test_one_group_in_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "SHARD", 50)
    monkeypatch.setattr(vectorgraph, "QUERIES", 40)
    r = np.random.default_rng(2)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(r.normal(size=16) + 0.01 * r.normal(size=(200, 16)))] + [(1000 + k, r.normal(size=16).tolist(), 0) for k in range(40)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectorgraph.near_duplicates(frame(spark, rows), threshold=0.95).collect()}
    assert all(got[k] == (199, 0) for k in range(200))
    assert all(got[1000 + k] == (0, 1000 + k) for k in range(40))
