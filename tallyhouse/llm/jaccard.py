"""Prefix-tree join of documents by the Jaccard similarity of their word n-gram sets.

The sets' items have one global order: by a level that grows with how often an item's hash bucket was seen in the whole table, then by hash. Two sets that
are similar enough share an item among the first few of each in that order, so only sets that meet at such an item are compared.
A comparison walks the prefix tree of a group of ordered sets with one probe: overlap gathered along a path is shared by all sets below it,
and a subtree is left when what remains of the probe and of its sets cannot reach the threshold.

Equal sets are one node. Each node is first compared with one partner of each group it meets in, the one it meets most often; that joins
the bulk of any large group of near copies in work that follows its size. Pairs that still lie in different components are then compared all, in blocks,
behind bounds that never reject a similar pair: members of a group's largest component meet only its other members. A group whose members all meet in an
earlier group, too, is left out. So no link that joins components is lost, and no group's pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.components import components
from tallyhouse.llm.shingles import HASH_BITS, MASK, shingle_sets
from tallyhouse.llm.storage import small_batches, written

#: The sketch of item counts: buckets, and the parts it is summed in. 2**20 counts are 1 MB as levels, whatever the corpus.
BUCKET_BITS, PARTS = 20, 64
#: Nodes that a block of a group of near misses holds, those that a block of its largest component holds, members that one walk of a tree takes, and the least bits of a node's parity sketch.
BLOCK, MAIN_BLOCK, WALK, PARITY_BITS = 512, 4096, 256, 1024
#: Items of this level or more may be in a quarter of a million sets or more; they are grouped by sums that are combined before the shuffle.
HOT_LEVEL = 10
#: Ids that are broadcast at most, 8 MB of them; more go through a shuffle join.
BROADCAST_IDS = 1_000_000
#: Characters of text hashed at a time.
CHARACTERS = 1 << 20


def _slices(texts: list[str | None]) -> Iterator[slice]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= CHARACTERS:
            yield slice(lo, k + 1)
            lo, held = k + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def item_levels(docs: DataFrame, width: int) -> np.ndarray:
    """A level from 0 to 15 for each bucket of item hashes, from counts over all documents."""
    n = 1 << BUCKET_BITS
    span = n // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in _slices(texts):
                grams = np.concatenate([*shingle_sets(texts[s], width), np.zeros(0, np.uint64)])
                seen += np.bincount((grams >> np.uint64(HASH_BITS - BUCKET_BITS)).astype(np.int64), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen[k * span : (k + 1) * span].astype("<u4").tobytes() for k in range(PARTS)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4" if len(counts) == 4 * span else "<i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    total = np.zeros(n, np.int64)
    summed = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(PARTS // 4, "part").mapInArrow(add, "part int, counts binary")
    for part, counts in summed.collect():  # PARTS rows of fixed size
        total[part * span : (part + 1) * span] = np.frombuffer(counts, "<i8")
    usual = total.mean()
    excess = total - usual - 6 * np.sqrt(usual) - 4
    return np.where(excess > 0, np.minimum(15, 1 + np.log2(np.maximum(excess, 1)) / 2), 0).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Items with their level above the hash, ascending: the global order."""
    level = levels[(grams >> np.uint64(HASH_BITS - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort(level << np.uint64(HASH_BITS) | grams & MASK)


def parity(grams: np.ndarray) -> bytes:
    """A bit for each residue modulo a power of two, that of the set's size or more: whether an odd number of items has it. Two sketches differ in no more bits than the sets do in items."""
    size = max(PARITY_BITS, 1 << (len(grams) - 1).bit_length()) if len(grams) else PARITY_BITS
    bits = np.bincount((grams % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of ``size`` bytes; longer ones are folded, which makes them those of a smaller modulus."""
    rows = np.zeros((len(sketches), size // 8), np.uint64)
    for k, s in enumerate(sketches):
        rows[k] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)
    return rows


def walk(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of ``sets`` are similar to ``probe``; all are ascending in the global order.

    The prefix tree is kept as its leaves in order: a node is a run of leaves that begin alike.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    leaves = [sets[k] for k in order]
    lengths = np.array([len(s) for s in leaves])
    n, found, stack = len(probe), [], [(0, len(leaves), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        a, b = leaves[lo], leaves[hi - 1]
        m = min(len(a), len(b))
        same = m if hi - lo == 1 else depth + int(np.argmin(np.append(a[depth:m] == b[depth:m], False)))
        path = a[depth:same]
        if len(path):
            at = np.searchsorted(probe, path)
            overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == path))
            rest = n - int(np.searchsorted(probe, path[-1], side="right"))
        else:
            rest = n if not same else n - int(np.searchsorted(probe, a[same - 1], side="right"))
        most = overlap + min(rest, int(lengths[lo:hi].max()) - same)
        if 100 * most < percent * (n + int(lengths[lo:hi].min()) - most):
            continue
        while lo < hi and lengths[lo] == same:
            if 100 * overlap >= percent * (n + same - overlap):
                found.append(order[lo])
            lo += 1
        while lo < hi:
            item, end = leaves[lo][same], lo + 1
            while end < hi and leaves[end][same] == item:
                end += 1
            stack.append((lo, end, same, overlap))
            lo = end
    return found


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar. Members of one probe are dealt to as many walks as they need."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walks = pairs.groupBy("a").agg(F.ceil(F.count("*") / WALK).cast("int").alias("walks"))
    members = pairs.join(walks, "a").select("a", F.pmod(F.xxhash64("b"), "walks").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    probes = walks.select("a", F.explode(F.sequence(F.lit(0), F.col("walks") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = probes.union(members).join(sets.select("id", "items"), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        probes: list[np.ndarray] = []
        ids: list[int] = []
        found: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            hit = {ids[k] for p in probes for k in walk(p, found, percent)} if found else set()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hit), pa.int64()), pa.array(list(hit), pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, salt, role, i, items in zip(*(batch.column(k).to_pylist() for k in ("a", "salt", "role", "id", "items")), strict=True):
                if (a, salt) != key or len(found) >= 2 * WALK:
                    if key is not None:
                        yield links()
                    if (a, salt) != key:
                        probes = []
                    key, ids, found = (a, salt), [], []
                if role:
                    ids.append(i)
                    found.append(np.frombuffer(items, "<u8"))
                else:
                    probes.append(np.frombuffer(items, "<u8"))
        if key is not None:
            yield links()

    dealt = rows.select("a", "salt", "role", "id", "items").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(work, "a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that neither the sets' sizes nor their parity sketches rule out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in ("n_a", "n_b"))
            both = list(zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist(), strict=True))
            apart = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([x, y], min(len(x), len(y))))).sum()) for x, y in both], np.int64)
            keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart * (100 + percent) <= (100 - percent) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs
    for side in ("a", "b"):
        both = both.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")), side)
    return both.mapInArrow(work, "a long, b long").distinct()


#: The block of a member of its group's largest component.
MAIN = -1


def _open_groups(met: DataFrame, first: DataFrame) -> DataFrame:
    """h, id, component of the meetings ``met`` (h, id) in groups that must be compared: those of several components.

    Left out are groups whose members all have the same item before this one, or the same first one, among the items that they share with others: each pair of them meets at that item.
    """
    in_order = W.Window.partitionBy("id").orderBy("h")
    placed = met.join(first, "id", "left").select("h", "id", F.coalesce("component", "id").alias("component"), F.lag("h").over(in_order).alias("last"), F.first("h").over(in_order).alias("lowest"))
    groups = placed.groupBy("h").agg(
        F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.count("last").alias("n_last"), F.min("last").alias("last_lo"), F.max("last").alias("last_hi"), F.min("lowest").alias("lowest_lo"), F.max("lowest").alias("lowest_hi"),
    )
    elsewhere = ((F.col("n_last") == F.col("n")) & F.coalesce(F.col("last_lo") == F.col("last_hi"), F.lit(False))) | ((F.col("lowest_lo") == F.col("lowest_hi")) & (F.col("lowest_lo") != F.col("h")))
    return placed.join(groups.where((F.col("lo") < F.col("hi")) & ~elsewhere).select("h", F.col("n").alias("size")), "h").select("h", "id", "component", "size")


def _blocks(open_: DataFrame) -> DataFrame:
    """``open_`` with the blocks that each member meets: h, p, q, m, id, component, block.

    A group of BLOCK members is one block. In a larger one the members outside the largest component, the strays, fall into blocks that meet each other,
    and each meets the blocks of the largest component: rows in proportion to the strays' blocks times the group, not to its square.
    """
    zero = F.lit(0)
    small = open_.where(F.col("size") <= BLOCK).select("h", zero.alias("p"), zero.alias("q"), zero.alias("m"), "id", "component", zero.alias("block"))
    large = open_.where(F.col("size") > BLOCK)
    main = large.groupBy("h", "component").count().groupBy("h").agg(F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("all"))
    parts = main.select("h", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.count")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("main.count") / MAIN_BLOCK).cast("int").alias("mains"))
    placed = large.join(parts, "h")
    strays = placed.where("component <> main").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other")
    among = strays.select("h", "id", "component", "block", other).select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), zero.alias("m"), "id", "component", "block")
    beside = strays.select("h", F.col("block").alias("p"), F.col("block").alias("q"), F.explode(F.sequence(F.lit(1), F.col("mains"))).alias("m"), "id", "component", "block")
    mains = placed.where("component = main").select("h", other, (F.pmod(F.xxhash64("id"), "mains") + 1).cast("int").alias("m"), "id", "component").select("h", F.col("other").alias("p"), F.col("other").alias("q"), "m", "id", "component", F.lit(MAIN).alias("block"))
    return small.union(among).union(beside).union(mains)


def _near_misses(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks p and q of one group, in different components, that neither length nor parity sketch rules out; where m is not 0, pairs of block p and the members of a block of the largest component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []

        def pairs() -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(held) > 1:
                _, p, q, m = key
                ids = np.array([r[0] for r in held], np.int64)
                comps = np.array([r[1] for r in held], np.int64)
                size = np.array([r[2] for r in held], np.int64)
                block = np.array([r[3] for r in held], np.int64)
                wide = np.array([len(r[4]) for r in held], np.int64)
                for z in np.unique(wide).tolist():  # pairs whose shorter sketch has z bytes
                    at = np.flatnonzero(wide >= z)
                    bits = folded([held[k][4] for k in at.tolist()], z)
                    for i, k in enumerate(at.tolist()):
                        if block[k] != p:
                            continue
                        fits = block[at] == MAIN if m else (block[at] == q) & (ids[at] > ids[k] if p == q else True)
                        other = np.flatnonzero(fits & (comps[at] != comps[k]) & (np.minimum(wide[at], wide[k]) == z))
                        s, t = np.minimum(size[at[other]], size[k]), np.maximum(size[at[other]], size[k])
                        other = other[100 * s >= percent * t]
                        if not len(other):
                            continue
                        apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1).astype(np.int64)
                        # similar sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes
                        for j in at[other[apart * (100 + percent) <= (100 - percent) * (size[at[other]] + size[k])]].tolist():
                            out.append((int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))))
            a, b = zip(*set(out), strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, p, q, m, *rest in zip(*(batch.column(k).to_pylist() for k in ("h", "p", "q", "m", "id", "component", "n", "block", "parity")), strict=True):
                if (h, p, q, m) != key:
                    if len(held) > 1:
                        yield pairs()
                    key, held = (h, p, q, m), []
                held.append(rest)
        if len(held) > 1:
            yield pairs()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "h", "p", "q", "m").sortWithinPartitions("h", "p", "q", "m", "id").mapInArrow(work, "a long, b long").distinct()


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Link documents (doc_id, text) whose sets of ``width``-word shingles have ``100 * intersection >= percent * union``.

    A row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and set_key, which equal sets share.
    A text with fewer words is one shingle of them all; one with none, or null, has an empty set and links with nothing. Rows with a null doc_id keep a null component_id
    and link with nothing. Rows that repeat a doc_id are one node: it has the links of each. Extra columns are ignored; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    levels = spark.sparkContext.broadcast(item_levels(docs, width))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in _slices(texts):
                n, keys, first, bits = [], [], [], []
                for grams in shingle_sets(texts[s], width):
                    items = ordered(grams, levels.value)
                    n.append(len(items))
                    keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                    first.append(items[: len(items) - -(-percent * len(items) // 100) + 1].tobytes() if len(items) else None)
                    bits.append(parity(items & MASK))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(first, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n", "key", "first", "parity"])

    rows = written(docs.mapInArrow(prefixes, "doc_id long, n int, key binary, first binary, parity binary"), "prefixes")
    real = rows.where("key is not null and doc_id is not null")
    nodes = real.groupBy("key").agg(F.min("doc_id").alias("id"))
    # rows of one doc_id with different sets: each set's node is the same document's
    several = real.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    twice = real.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(nodes, "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    one_each = real.groupBy("key").agg(F.min(F.struct("doc_id", "n", "first")).alias("r")).select(F.col("r.doc_id").alias("id"), "r.n", "r.first")

    def spread(hot: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, n, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    h = np.frombuffer(first, "<u8")
                    h = h[(h >> np.uint64(HASH_BITS) >= HOT_LEVEL) == hot].astype(np.int64)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i, np.int64)), pa.array(np.full(len(h), n, np.int32))], names=["h", "id", "n"])

        return one_each.mapInArrow(work, "h long, id long, n int")

    group = W.Window.partitionBy("h")
    met = spread(False).withColumns({"leader": F.min("id").over(group), "last": F.max("id").over(group)}).where("leader < last").select("h", "id", "leader")
    if levels.value.max() >= HOT_LEVEL:
        often = spread(True)
        leaders = often.groupBy("h").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
        met = met.union(often.join(leaders, "h").select("h", "id", "leader"))
    met = written(met, "meetings")

    partner = met.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("times")).groupBy("id").agg(F.max(F.struct("times", (-F.col("leader")).alias("l"))).alias("best"))
    first_pairs = written(partner.select((-F.col("best.l")).alias("a"), F.col("id").alias("b")), "pairs")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in _slices(texts):
                sets = [ordered(g, levels.value).tobytes() for g in shingle_sets(texts[s], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array(sets, pa.binary())], names=["id", "items"])

    def verified(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi")
        sets = written(texts.mapInArrow(whole, "id long, items binary").where(F.length("items") > 0), "sets")
        return written(_verify(pairs, sets, percent), "links")

    sketches = written(real.select(F.col("doc_id").alias("id"), "n", "parity").distinct(), "sketches")
    links = verified(written(_possible(first_pairs, sketches, percent), "pairs"))
    links = links.union(twice)
    open_ = _open_groups(met.select("h", "id"), components(links))
    near = _blocks(open_).join(sketches, "id").select("h", "p", "q", "m", "id", "component", "n", "block", "parity")
    joined = components(links.union(verified(written(_near_misses(near, percent), "pairs"))))

    by_key = nodes.join(joined, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    return rows.select("doc_id", "n", "key").join(by_key, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.col("key").alias("set_key"))
