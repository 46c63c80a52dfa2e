"""Resampling of a corpus towards a target distribution by hashed n-gram features.

Every document's weight is the sum of its features' gains, looked up in an array of one gain a bucket. A fixed noise per
document added to it makes the highest scores a draw without replacement. The draw is exact: a bound far down the scores
is estimated and counted, what lies above it is dealt by ranges of the score, each task brings its rows as sorted runs,
and a range's runs are merged by a tournament tree that stops when the draw is full.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shards import MOST_BOUNDS, with_shards
from tallyhouse.llm.storage import small_batches, written

#: Words that are hashed at once; rows a range of scores has at least.
WORDS_AT_ONCE, ROWS_PER_RANGE = 1 << 16, 1024
#: Bytes that belong to words once A-Z are lower case; all others part words.
_KEPT = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_WORDS = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEPT else b if b in _KEPT else 0x20 for b in range(256))


def features(text: str | None, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The features' buckets of a text, block by block, each with how many words it has. A feature's checksum goes on from that of the words before its last."""
    words = (text or "").encode().translate(_WORDS).split()
    crc = zlib.crc32
    one = two = None  # checksums of the runs of one and two words that end at the word before
    for at in range(0, len(words), WORDS_AT_ONCE):
        block = words[at : at + WORDS_AT_ONCE]
        found: list[int] = []
        for word in block:
            own = crc(word)
            found.append(own)
            if one is not None:
                spaced = b" " + word
                pair = crc(spaced, one)
                found.append(pair)
                if two is not None:
                    found.append(crc(spaced, two))
                two = pair
            one = own
        yield len(block), np.array(found, np.uint32) % np.uint32(buckets)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, found in features(text, buckets):
                counts += np.bincount(found, minlength=buckets)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "n": pa.array(counts[full], pa.int64())})


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts (column ``text``) fall into each bucket; what tasks hand on has a row a bucket at most."""
    counts = np.zeros(buckets, np.int64)
    parts = texts.select("text").mapInArrow(partial(_counted, buckets=buckets), "bucket int, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """A long for each bucket: how much likelier a feature in it is in the target than in the corpus, as a scaled logarithm rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int, scale: int = 1000) -> int:
    """The fixed noise of a document, of a Gumbel distribution."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(batches: Iterator[pa.RecordBatch], gain: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_features, weights, scores = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = n = weight = 0
            for k, found in features(text, len(gain)):
                words, n, weight = words + k, n + len(found), weight + int(gain[found].sum())
            n_words.append(words)
            n_features.append(n)
            weights.append(weight)
            scores.append(weight + noise(doc_id, seed))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weights, pa.int64()), "score": pa.array(scores, pa.int64())})


def score(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` (doc_id, text). A null text has no words; a null id is an empty one in the noise."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scored, gain=gain, seed=seed), "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """Merges sorted sequences: a tree of matches, in each of which the smaller head wins; a winner's place is played again from its leaf up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, n = runs, [0] * len(runs), 1
        while n < len(runs):
            n *= 2
        self.leaves = n
        self.tree = [-1] * n + [k if k < len(runs) and runs[k] else -1 for k in range(n)]
        for node in range(n - 1, 0, -1):
            self.tree[node] = self._match(node)

    def _match(self, node: int) -> int:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        if a < 0 or b < 0:
            return max(a, b)
        return b if self.runs[b][self.at[b]] < self.runs[a][self.at[a]] else a

    def __iter__(self) -> Iterator[tuple]:
        while (run := self.tree[1]) >= 0:
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = self.leaves + run
            if self.at[run] == len(self.runs[run]):
                self.tree[node] = -1
            while node > 1:
                node //= 2
                self.tree[node] = self._match(node)


_RUN = "shard long, run long, down long, doc_id long, n_features long, weight long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a sorted run, numbered by its task and its place in it."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        ordered = batch.sort_by([("shard", "ascending"), ("down", "ascending"), ("doc_id", "ascending"), ("n_features", "ascending"), ("weight", "ascending")])
        columns = {"shard": ordered.column(0), "run": pa.array([task << 32 | k] * len(batch), pa.int64())}
        yield pa.RecordBatch.from_pydict(columns | {batch.schema.names[c]: ordered.column(c) for c in range(1, 5)})


def _ranked(batches: Iterator[pa.RecordBatch], before: dict[int, int], draw: int) -> Iterator[pa.RecordBatch]:
    """Rows come range by range, a range's run by run, each in order."""
    own: int | None = None
    runs: dict[int, list[tuple]] = {}

    def merged() -> Iterator[pa.RecordBatch]:
        rows, left, rest = [], draw - before[own], []
        ordered = iter(Tournament(list(runs.values())))
        for k in range(left):  # no further: what is not drawn needs no order
            row = next(ordered, None)
            if row is None:
                break
            rows.append((*row, before[own] + k + 1))
            if len(rows) == 1 << 14:
                yield _told(rows)
                rows = []
        rest = [(*row, None) for row in ordered]
        yield _told(rows + rest)

    for batch in batches:
        for shard, run, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != own:
                if own is not None:
                    yield from merged()
                own, runs = shard, {}
            runs.setdefault(run, []).append(tuple(row))
    if own is not None:
        yield from merged()


def _told(rows: list[tuple]) -> pa.RecordBatch:
    down, doc_id, n, weight, rank = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64()), "score": pa.array([-d for d in down], pa.int64()), "rank": pa.array(rank, pa.int64())})


def drawn(scored: DataFrame, eligible: Column, percent: int = 5) -> DataFrame:
    """Every row of ``scored`` (doc_id, n_features, weight, score; a stored table, as it is read several times) with its rank: 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N eligible rows, ties to the smaller doc_id, null for the rest.

    Rows without an id are not eligible. Rows that share score and id, being repeated, are told apart by their other
    columns and then take ranks in turn. No rows and no eligible ones are no ranks.
    """
    rows = scored.select("doc_id", "n_features", "weight", "score", (F.coalesce(eligible, F.lit(False)) & F.col("doc_id").isNotNull()).alias("eligible"))
    unranked = F.lit(None).cast("long").alias("rank")
    able = rows.where("eligible")
    n = able.count()
    draw = percent * n // 100
    if not draw:
        return rows.select("doc_id", "n_features", "weight", "score", unranked)
    likely = max(0.0, 1 - draw / n - 0.001)
    bound = able.agg(F.percentile_approx("score", likely, 10_000)).first()[0]
    reached = able.where(F.col("score") >= bound).count()
    if reached < draw:  # the estimate was too high: without it
        bound, reached = able.agg(F.min("score")).first()[0], n
    top = able.where(F.col("score") >= bound).select("doc_id", "n_features", "weight", (-F.col("score")).alias("down"))
    dealt, _ = with_shards(top, "down", max(ROWS_PER_RANGE, -(-reached // MOST_BOUNDS)))
    before, total = {}, 0
    for r in dealt.groupBy("shard").count().orderBy("shard").collect():  # a row a range, MOST_BOUNDS + 1 at most
        if total < draw:
            before[r["shard"]] = total
        total += r["count"]
    last = max(before)
    runs = dealt.where(F.col("shard") <= last).select("shard", "down", "doc_id", "n_features", "weight").mapInArrow(_runs, _RUN)
    ordered = runs.repartition("shard").sortWithinPartitions("shard", "run", "down", "doc_id", "n_features", "weight")
    ranked = ordered.mapInArrow(partial(_ranked, before=before, draw=draw), "doc_id long, n_features long, weight long, score long, rank long")
    below = dealt.where(F.col("shard") > last).select("doc_id", "n_features", "weight", (-F.col("down")).alias("score"), unranked)
    others = rows.where(~F.col("eligible") | (F.col("score") < bound)).select("doc_id", "n_features", "weight", "score", unranked)
    return ranked.union(below).union(others)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_features, weight, score and, where it is drawn, its rank: a sample of ``docs`` that is distributed as ``target`` (text) is.

    Null and empty texts have no feature and weight 0; texts of fewer than ``least_words`` words and rows without an id
    are scored and never drawn. An empty target makes all gains those of unseen features. Repeated rows count and are
    drawn each. An empty table gives an empty one; extra columns are ignored. Texts are read twice, as counts of the
    whole corpus come first; scores are written once.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = written(score(docs, gain, seed), "importance")
    return drawn(scored, F.col("n_words") >= least_words, percent)
