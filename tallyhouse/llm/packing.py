"""Order-preserving packing of documents into windows of tokens by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shards import with_shards
from tallyhouse.llm.storage import small_batches
from tallyhouse.llm.wordids import sentence_ends, word_ids

#: Cost in padding tokens of a window that begins inside a document, and of one that begins inside a sentence.
INSIDE_DOCUMENT, INSIDE_SENTENCE = 8, 200
#: Lengths that need no padding: powers of two, from this one on. Shorter windows would only be many.
LEAST_POWER = 512
#: Tokens whose cuts are chosen together; a task holds about so many, and one document more.
RUN = 4_000_000


def cut_windows(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Cuts that cost least: ``places`` ascend from 0, no two further apart than ``window``; ``penalty`` is what a cut there costs.

    cost[j] = penalty[j] + min over i of cost[i] + padding(places[j] - places[i]). Padding is window less length, and none at a power of two.
    The first form's minimum of cost[i] + places[i] over a sliding range is at the head of a monotone queue; the second looks up
    one place for each power of two.
    """
    at = places.tolist()
    fine = penalty.tolist()
    powers = [1 << k for k in range(LEAST_POWER.bit_length() - 1, window.bit_length()) if LEAST_POWER <= 1 << k < window]
    index = {p: i for i, p in enumerate(at)}
    cost, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        best = key + window - p
        for size in powers:
            k = index.get(p - size)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += fine[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def _places(lengths: list[int], ends: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, and what each cut costs: at documents' ends, after sentences, and within those that no window holds."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    kind = np.zeros(int(starts[-1]) + 1, np.uint8)  # of each place: 0 none, 1 within a sentence, 2 after one, 3 at a document's end
    for e, s in zip(ends, starts[:-1].tolist(), strict=True):
        kind[e + s] = 2
    kind[starts] = 3
    places = np.flatnonzero(kind)
    gaps = np.diff(places)
    for k in np.flatnonzero(gaps > window).tolist():
        kind[places[k] + window : places[k + 1] : window] = 1
    places = np.flatnonzero(kind)
    return places, np.array([0.0, INSIDE_SENTENCE, INSIDE_DOCUMENT, 0.0])[kind[places]]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, rows_per_shard: int = 2500, with_ids: bool = False) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``window`` tokens, in ascending doc_id.

    A row a piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset, with
    ``with_ids`` also the ids. Documents fall into ranges of doc_id of about ``rows_per_shard`` rows, and each range is
    packed by one task, a run of documents of about RUN tokens at a time; at its end one window may stay short. A null text is empty: it is the end id
    alone. Repeated rows are packed each for itself, rows of one doc_id in order of their text; a null doc_id comes first. No documents give no pieces. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in kind.split(", ")]

    def rows(shard: int, run: int, ids: list[np.ndarray], doc_ids: list[int | None], ends: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        places, penalty = _places([len(x) for x in ids], ends, window)
        cuts = cut_windows(places, penalty, window)
        out: list[list] = [[] for _ in names]
        begin, cut, lo = 0, 0, 0
        for doc, x in zip(doc_ids, ids, strict=True):
            hi, at = begin + len(x), begin
            while at < hi:
                while cuts[cut] <= at:
                    lo = cuts[cut]
                    cut += 1
                to = min(hi, cuts[cut])
                piece = x[at - begin : to - begin]
                for column, v in zip(out, (doc, at - begin, to - at, zlib.crc32(piece.astype("<u4").tobytes()), len(x), shard << 32 | run + cut, at - lo, *[piece.astype(np.int32)] * with_ids), strict=True):
                    column.append(v)
                at = to
            begin = hi
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names), run + len(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, is_end = word_ids(tokenizer), sentence_ends(tokenizer)
        shard, run, held = None, 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        ends: list[np.ndarray] = []
        for batch in batches:
            for s, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ids and (s != shard or held >= RUN):
                    found, run = rows(shard, run, ids, doc_ids, ends)
                    yield found
                    ids, doc_ids, ends, held = [], [], [], 0
                if s != shard:
                    shard, run = s, 0
                x = np.frombuffer(encoder.encode(text), encoder.dtype)
                ids.append(np.append(x, np.asarray([end_id], x.dtype)))
                doc_ids.append(doc)
                ends.append(np.flatnonzero(is_end[x]) + 1)
                held += len(x) + 1
        if ids:
            yield rows(shard, run, ids, doc_ids, ends)[0]

    placed, n = with_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", rows_per_shard)
    return placed.select("shard", "doc_id", "text").repartitionByRange(n, "shard").sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(work, kind)
