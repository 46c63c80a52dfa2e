"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors fall into overlapping clusters, and large clusters into shards. On each shard a graph of near and of random neighbours is
built and pruned so that no kept neighbour is much nearer to another kept one; the shards' adjacency lists are united. Every vector then searches its
own cluster: a greedy walk from the medoids of its shards, then expansion to all that lie in range. Where a united list leads from there to a vector of another cluster
that may be in range, the search goes on in that cluster, until it leads nowhere new. What it meets is verified in double precision.
Each pair that was found counts once, for both of its ends. Recall is audited against brute force over all rows, and the overlap widened if it falls short.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.storage import written
from tallyhouse.llm.vectors import dimension_of, lloyd, matrix, sample, valid_rows

_LOG = logging.getLogger(__name__)
#: Vectors a cluster and a shard are meant to have, and centres learned at a time: a table that needs more clusters has its clusters cut again.
CLUSTER, SHARD, MOST_CLUSTERS = 2000, 4000, 4096
#: Vectors that the centres within a cluster are learned from at most.
LEARN_WITHIN = 20_000
#: Queries that meet a shard in one task; more of them meet copies of the shard in other tasks.
QUERIES = 32_000
#: Vectors that a pass of the audit asks at most.
AUDIT_BLOCK = 4096
#: Neighbours kept, near and random ones looked at; the pruning factor.
DEGREE, NEAR, RANDOM, ALPHA = 24, 48, 48, 1.2
#: Expansion goes on from vectors this much below the threshold too.
SLACK = 0.05
#: A list's entry: a neighbour, its cosine and its cluster.
ENTRY = np.dtype([("id", "<i8"), ("cosine", "<f4"), ("home", "<i4")])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(x: np.ndarray, near: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each row: of candidates in order of distance, those that no kept one is ALPHA times nearer to; links go both ways."""
    n = len(x)
    random = np.random.default_rng(seed)
    kept: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        c = np.unique(np.concatenate([near[i], random.integers(0, n, min(RANDOM, n))]))
        c = c[c != i]
        to = 1 - x[c] @ x[i]
        c = c[np.argsort(to, kind="stable")]
        v = x[c]
        own, among = 1 - v @ x[i], 1 - v @ v.T
        alive = np.ones(len(c), bool)
        for k in range(len(c)):
            if alive[k]:
                kept[i].add(int(c[k]))
                if len(kept[i]) >= DEGREE:
                    break
                alive &= ALPHA * among[k] > own
    back: list[set[int]] = [set() for _ in range(n)]
    for i, ks in enumerate(kept):
        for k in ks:
            back[k].add(i)
    return [np.array(sorted(a | b), np.int64) for a, b in zip(kept, back, strict=True)]


def range_search(x: np.ndarray, lists: list[np.ndarray], q: np.ndarray, starts: list[int], threshold: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a walk from ``starts`` meets with ``x @ q >= threshold - slack``, and these products."""
    seen = np.zeros(len(x), bool)
    frontier = np.array(sorted(set(starts)))
    seen[frontier] = True
    score = x[frontier] @ q
    best, least = score.max(), threshold - slack
    hits, scores = [frontier[score >= least]], [score[score >= least]]
    while len(frontier):
        around = np.unique(np.concatenate([lists[k] for k in frontier.tolist()]))
        around = around[~seen[around]]
        if not len(around):
            break
        seen[around] = True
        score = x[around] @ q
        hits.append(around[score >= least])
        scores.append(score[score >= least])
        # in range: go on from all of them; not yet there: from those that come nearer, and the nearest few
        on = score >= least
        if not on.any() and score.max() > best:
            on = score >= np.partition(score, max(0, len(score) - 4))[max(0, len(score) - 4)]
        best = max(best, score.max())
        frontier = around[on]
    return np.concatenate(hits), np.concatenate(scores)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal keys, a batch's part at a time."""
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        lo = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[lo]:
                yield values[lo], batch.slice(lo, k - lo)
                lo = k


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, as tables."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for at, run in _runs(batches, keys):
        if at != key:
            if held:
                yield key, pa.Table.from_batches(held)
            key, held = at, []
        held.append(run)
    if held:
        yield key, pa.Table.from_batches(held)


def _matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("v").to_pylist()), "<f8").reshape(t.num_rows, -1)


class Shard:
    """A shard's vectors and lists in memory, searched by any number of batches of queries.

    A pair counts once, whoever finds it: of two vectors of one cluster the smaller id counts it. A query from another cluster counts what it
    meets unless that has searched the query's cluster before, or does so in the same round and has the smaller id.
    """

    def __init__(self, cluster: int, t: pa.Table, threshold: float, slack: float = SLACK):
        self.cluster, self.threshold, self.slack = cluster, threshold, slack
        self.x, self.ids, self.copies = _matrix(t), t.column("node").to_numpy(), t.column("copies").to_numpy()
        self.before, self.now = t.column("before").to_pylist(), t.column("now").to_pylist()
        order = np.argsort(self.ids)
        self.around, outside = [], []
        for owner, parts in enumerate(t.column("around").to_pylist()):
            a = np.frombuffer(b"".join(parts), ENTRY)
            k = np.minimum(np.searchsorted(self.ids[order], a["id"]), len(self.ids) - 1)
            self.around.append(np.unique(order[k[self.ids[order][k] == a["id"]]]))
            a = a[a["home"] != cluster]
            outside.append(np.rec.fromarrays([np.full(len(a), owner), np.arccos(np.clip(a["cosine"], -1, 1)), a["home"]], names="owner,angle,home"))
        self.first = np.cumsum([0, *map(len, outside)])
        self.outside = np.concatenate(outside)
        self.at = {int(i): k for k, i in enumerate(self.ids)}
        self.medoid = int((self.x @ self.x.mean(axis=0)).argmax())
        self.credit = np.zeros(len(self.ids), np.int64)
        self.searched: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.top: dict[int, int] = {}

    def _root(self, i: int) -> int:
        top = self.top
        while top.setdefault(i, i) != i:
            top[i] = i = top[top[i]]
        return i

    def _counts(self, i: int, home: int, hits: np.ndarray) -> np.ndarray:
        """Which hits of query ``i`` count."""
        if home == self.cluster:
            return self.ids[hits] > i
        if home not in self.searched:
            self.searched[home] = np.array([home in s for s in self.before]), np.array([home in s for s in self.now])
        before, now = self.searched[home]
        return ~before[hits] & (~now[hits] | (self.ids[hits] > i))

    def _onward(self, near: np.ndarray, score: np.ndarray) -> set[int]:
        """Clusters of listed neighbours that may be as near to the query as expansion goes: the angle to them is at least the difference of the two that are known."""
        n = self.first[near + 1] - self.first[near]
        if not n.sum():
            return set()
        at = np.repeat(self.first[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        angle = np.repeat(np.arccos(np.clip(score, -1, 1)), n)
        part = self.outside[at]
        return set(part["home"][np.cos(angle - part["angle"]) >= self.threshold - self.slack].tolist())

    def search(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        """Links of each query, clusters to go on to, and an edge from each that is not of this shard; what the shard's own vectors have is kept for ``rest``."""
        out: list[tuple] = []
        for i, home, copies, q in zip(*(queries.column(k).to_pylist() for k in ("node", "home", "copies")), _matrix(queries), strict=True):
            inside = i in self.at
            near, score = range_search(self.x, self.around, q, [self.medoid] + ([self.at[i]] if inside else []), self.threshold, self.slack)
            out += [(i, None, None, c) for c in self._onward(near, score) if c != home]
            hits = near[(score >= self.threshold) & (self.ids[near] != i)]
            counted = hits[self._counts(i, home, hits)]
            self.credit[counted] += copies
            out.append((i, int(self.copies[counted].sum()), None, None))
            met = self.ids[hits].tolist()
            if met and not inside:
                out.append((i, None, met[0], None))
            for j in met:
                a, b = self._root(i if inside else met[0]), self._root(j)
                if a != b:
                    self.top[max(a, b)] = min(a, b)
        return _finds(out)

    def rest(self) -> pa.RecordBatch:
        """What was counted for the shard's own vectors, and edges that span what they share: fewer than it has vectors."""
        return _finds([(int(i), int(n), None, None) for i, n in zip(self.ids, self.credit, strict=True) if n] + [(i, None, self._root(i), None) for i in list(self.top) if self._root(i) != i])


def _finds(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["node", "links", "root", "onward"])


def find_links(batches: Iterator[pa.RecordBatch], threshold: float, slack: float = SLACK) -> Iterator[pa.RecordBatch]:
    """Search shards (role 0) by the queries that follow them (role 1), which are held a batch at a time."""
    key, held, shard = None, [], None
    for (*at, role), run in _runs(batches, ["cluster", "shard", "block", "role"]):
        if at != key:
            if shard:
                yield shard.rest()
            key, held, shard = at, [], None
        if role == 0:
            held.append(run)
            continue
        if shard is None and held:
            shard, held = Shard(key[0], pa.Table.from_batches(held), threshold, slack), []
        if shard:
            yield shard.search(run)
    if shard:
        yield shard.rest()


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9, overlap: int = 2, learn_from: int = 20_000, audit: int = 100, recall: float = 0.95, audit_most: int = 65_536) -> DataFrame:
    """Link vectors with cosine of at least ``threshold``: the id, n_links, component_id (smallest id reachable) and kept, a row per row of ``rows``.

    Vectors that are null, empty, zero, of another length than most or not finite in all components link with nothing and are their own component; a row without an id keeps a null component and is kept. Rows that repeat an id are vectors
    of their own for n_links and one node for components. Extra columns are ignored; an empty table gives an empty one.
    Equal vectors are one node with a count. Centres come from at most ``learn_from`` vectors; all rows are indexed and searched.
    At every size AUDIT_BLOCK vectors or more, until half of ``audit`` have links, all were asked or ``audit_most`` were, are held against all rows by brute force; below ``recall``, a mean over those with links, the search is done again with two more clusters for each vector.
    Where all vectors were asked, every link is known and none may be missing: the search is then done again with more clusters and a further expansion until it has them all. The recall reached is logged.
    Where ``audit_most`` vectors hold too few with links, ``audit`` of those that the search found links for are held against all rows as well; if it found none either, it is done once more with two more clusters.
    """
    spark = rows.sparkSession
    result = f"{id_column} long, n_links long, component_id long, kept boolean"
    d = dimension_of(rows, id_column, vector_column)
    every = rows.select(F.col(id_column).cast("long").alias("id"))
    if d is None:
        return every.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    valid = valid_rows(rows, id_column, vector_column, d)
    members = written(valid.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x + F.lit(0.0)))), ""), 256)), "vectors")
    nodes = written(members.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")), "nodes")
    n = nodes.count()
    clusters = max(1, round(n / CLUSTER))
    finer = -(-clusters // MOST_CLUSTERS)
    centres = _unit(lloyd(_unit(sample(nodes.select(F.col("node").alias("id"), "v"), learn_from)), -(-clusters // finer)))
    asked, last = _audit_sample(nodes, audit, threshold, audit_most, AUDIT_BLOCK)
    again, slack = True, SLACK
    while True:
        found, edges = _search(nodes, centres, min(overlap, len(centres)), threshold, finer, slack)
        known = asked
        if last and 2 * sum(links > 0 for _, links in asked) < audit:
            known = asked + _audit_found(nodes.where(F.col("key") > last), nodes, found, audit, threshold)
        reached = _recall(found, known)
        _LOG.info("recall %.4f over %d audited vectors, %d clusters a vector, slack %.2f", reached, len(known), overlap, slack)
        if reached >= (recall if last else 1.0):
            if not last or not again or any(links for _, links in known):
                break
            again = False
        elif overlap >= len(centres) and slack > 2:  # every vector was met
            break
        if not last or overlap >= len(centres):
            slack *= 2
        overlap += 2
    joined = components(edges)
    by_node = nodes.select("key", "node", "copies").join(found, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    by_key = by_node.select("key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = members.select("id", "key").join(by_key, "key").select("id", "n_links", "component_id")
    rest = rows.where(~(F.coalesce(_takes_part(id_column, vector_column, d), F.lit(False)))).select(F.col(id_column).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_column).cast("long").alias("component_id"))
    return linked.union(rest).select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _takes_part(id_column: str, vector_column: str, d: int):
    from tallyhouse.llm.vectors import usable

    return F.col(id_column).isNotNull() & usable(vector_column) & (F.size(vector_column) == d)


def _nearest_clusters(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def _placements(cluster: np.ndarray, own: np.ndarray, batch: pa.RecordBatch, at: np.ndarray, v: pa.Array) -> pa.RecordBatch:
    take = pa.array(at)
    return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(own), batch.column("node").take(take), batch.column("copies").take(take), v.take(take)], names=["cluster", "own", "node", "copies", "v"])


PLACED = "cluster int, own boolean, node long, copies long, v binary"


def _place(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """Each node in the clusters of its ``overlap`` nearest centres; ``own`` is the nearest."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(matrix(batch.column("v")))
            near = _nearest_clusters(x, shared.value, overlap)
            at = np.arange(near.size)
            v = pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())
            yield _placements(near.reshape(-1), at % near.shape[1] == 0, batch, at // near.shape[1], v)

    return nodes.select("node", "copies", "v").mapInArrow(assign, PLACED)


def _place_within(placed: DataFrame, finer: int, overlap: int) -> DataFrame:
    """Clusters cut into ``finer`` each, by centres learned from LEARN_WITHIN of their own vectors at most; vectors of other clusters join the nearest one.

    A cluster's centres come to tasks before its vectors; a large one is dealt to several tasks.
    """
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = placed.where("own").groupBy("cluster").count()
    part = F.least(F.lit(1.0), F.lit(float(LEARN_WITHIN)) / F.col("count"))
    some = placed.where("own").join(sizes, "cluster").where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < part * (1 << 20)).select("cluster", "node", "v")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x = np.stack([np.frombuffer(v, "<f8") for v in frame["v"]])
        return pd.DataFrame({"cluster": frame["cluster"][:1], "v": [_unit(lloyd(x, finer)).astype("<f8").tobytes()]})

    centres = some.groupBy("cluster").applyInPandas(learn, "cluster int, v binary")
    blocks = sizes.select("cluster", F.ceil(F.col("count") / QUERIES).cast("int").alias("blocks"))
    heads = centres.join(blocks, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.lit(False).alias("own"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), "v")
    rows = placed.join(blocks, "cluster").select("cluster", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "own", "node", "copies", "v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0)
        for (cluster, _, role), run in _runs(batches, ["cluster", "block", "role"]):
            if role == 0:
                known = np.frombuffer(run.column("v")[0].as_py(), "<f8")
                continue
            x = _matrix(run)
            known = known.reshape(-1, x.shape[1])
            near = _nearest_clusters(x, known, overlap)
            own = np.asarray(run.column("own").to_pylist())
            keep = own[:, None] | (np.arange(near.shape[1]) == 0)
            at, place = np.nonzero(keep)
            yield _placements(cluster * finer + near[at, place], own[at] & (place == 0), run, at, run.column("v"))

    return heads.union(rows).repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", "role").mapInArrow(assign, PLACED)


def _search(nodes: DataFrame, centres: np.ndarray, overlap: int, threshold: float, finer: int = 1, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """links per node (node, links: other rows within range of it), and edges (a, b) that span what was found."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(_place(nodes, centres, overlap), "clusters")
    if finer > 1:
        placed = written(_place_within(placed, finer, overlap), "clusters")
    homes = placed.where("own").select("node", F.col("cluster").alias("home"))
    shards = placed.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))  # a row a cluster
    dealt = placed.join(homes, "node").join(shards, "cluster").withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, shard), t in _groups(batches, ["cluster", "shard"]):
            ids, home, x = t["node"].to_numpy(), t["home"].to_numpy(), _matrix(t)
            near = []
            for lo in range(0, len(x), 512):
                s = x[lo : lo + 512] @ x.T
                near.append(np.argpartition(-s, min(NEAR, len(x) - 1), axis=1)[:, : NEAR + 1])
            around = []
            for i, ks in enumerate(robust_prune(x, np.concatenate(near), seed=cluster * 65537 + shard)):
                entries = np.empty(len(ks), ENTRY)
                entries["id"], entries["cosine"], entries["home"] = ids[ks], x[ks] @ x[i], home[ks]
                around.append(entries.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(around, pa.binary())], names=["node", "around"])

    built = dealt.repartition(n, "cluster", "shard").sortWithinPartitions("cluster", "shard", "node").mapInArrow(build, "node long, around binary")
    united = built.groupBy("node").agg(F.collect_list("around").alias("around"))
    data = written(dealt.where("own").join(united, "node").select("cluster", "shard", "shards", "node", "copies", "v", "around"), "graph")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from find_links(batches, threshold, slack)

    searched = homes.select("node", F.col("home").alias("cluster"), F.lit(1).alias("round"))
    finds: list[DataFrame] = []
    while True:
        now = len(finds) + 1
        blocks = searched.where(F.col("round") == now).groupBy("cluster").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        history = searched.groupBy("node").agg(F.collect_list(F.when(F.col("round") < now, F.col("cluster"))).alias("before"), F.collect_list(F.when(F.col("round") == now, F.col("cluster"))).alias("now"))
        rows = data.join(blocks, "cluster").join(history, "node").select("cluster", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "node", F.col("cluster").alias("home"), "copies", "v", "around", "before", "now")
        vectors = data.select("node", F.col("cluster").alias("home"), "copies", "v")
        asking = searched.where(F.col("round") == now).join(blocks, "cluster").join(data.select("cluster", "shards").distinct(), "cluster").join(vectors, "node")
        nothing, none = F.array().cast("array<binary>").alias("around"), F.array().cast("array<int>")
        asking = asking.select("cluster", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "node", "home", "copies", "v", nothing, none.alias("before"), none.alias("now"))
        both = rows.union(asking).repartition(n, "cluster", "shard", "block").sortWithinPartitions("cluster", "shard", "block", "role", "node")
        finds.append(written(both.mapInArrow(find, "node long, links long, root long, onward int"), "finds"))
        onward = finds[-1].where("onward is not null").select("node", F.col("onward").alias("cluster")).distinct().join(searched, ["node", "cluster"], "left_anti").withColumn("round", F.lit(now + 1))
        onward = written(onward, "onward")
        if not onward.take(1):
            break
        searched = searched.union(onward)
    found = reduce(DataFrame.union, finds)
    return found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")), found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _audit_sample(nodes: DataFrame, n: int, threshold: float, most: int, first: int = 0) -> tuple[list[tuple[int, int]], str | None]:
    """(node, links) by brute force of ``n`` nodes or more (``first`` at once) in order of their keys, and the last key if these are not all nodes: blocks of growing size are asked until half of ``n`` have links, all nodes were asked or ``most`` were; a pass over all rows a block."""
    asked: list[tuple[int, int]] = []
    after, size = "", min(max(n, first), most)
    while True:
        chosen = nodes.where(F.col("key") > after).orderBy("key").limit(size).select("key", "node", "v").collect()
        if chosen:
            asked += _brute_force(nodes, np.array([r["node"] for r in chosen]), _unit(np.array([r["v"] for r in chosen])), threshold)
        if len(chosen) < size:
            return asked, None
        if len(asked) >= most or 2 * sum(links > 0 for _, links in asked) >= n:
            return asked, chosen[-1]["key"]
        after, size = chosen[-1]["key"], min(4 * size, AUDIT_BLOCK, most - len(asked))


def _audit_found(some: DataFrame, nodes: DataFrame, found: DataFrame, n: int, threshold: float) -> list[tuple[int, int]]:
    """(node, links) by brute force of ``n`` of those nodes of ``some`` that the search found links for, by the hash of their vectors."""
    linked = some.join(found.where("links > 0").select("node"), "node", "left_semi")
    chosen = linked.orderBy("key").limit(n).select("node", "v").collect()
    if not chosen:
        return []
    return _brute_force(nodes, np.array([r["node"] for r in chosen]), _unit(np.array([r["v"] for r in chosen])), threshold)


def _brute_force(nodes: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(node, links) of vectors ``x`` of nodes ``ids``, held against all rows."""
    shared = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, of = np.nonzero(_unit(matrix(part.column("v"))) @ q.T >= threshold)
                other = part.column("node").to_numpy()[row] != ids[of]
                np.add.at(total, of[other], part.column("copies").to_numpy()[row[other]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(total)], names=["place", "links"])

    summed = nodes.select("node", "copies", "v").mapInArrow(count, "place long, links long").groupBy("place").agg(F.sum("links").alias("links"))
    found = [(int(ids[r["place"]]), r["links"]) for r in summed.collect()]
    shared.unpersist()
    return found


def _recall(found: DataFrame, asked: list[tuple[int, int]]) -> float:
    """Mean over the audited vectors with links of the part of them that was found; 1 if all rows were asked and none has links."""
    known: dict[int, int] = {}
    for node, links in asked:
        if links:
            known[node] = known.get(node, 0) + links
    if not known:
        return 1.0
    some = found.sparkSession.createDataFrame([(k,) for k in known], "node long")
    got = {r["node"]: r["links"] for r in found.join(F.broadcast(some), "node", "left_semi").collect()}
    return sum(min(v, got.get(k, 0)) / v for k, v in known.items()) / len(known)
