"""Approximate nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are cut into parts of two components, each coded by one of 16 centres. Codes and centres minimise a loss that weighs the
residual along a vector more than that across it, since the first is what shifts large inner products. The nearest vector by
Euclidean distance has the largest inner product with the query less half its own squared length; the latter is kept exactly.
A scan adds table entries for each byte of two codes; the best of each query are measured again on the original vectors, and so is
every row that may be nearer than the k-th of these, its distance from the query being that of its code less its own distance from its code at least.

A large table is cut into cells around centres, and a query meets the cells nearest to it. Recall is audited against brute force over all rows, and more
cells are met until it suffices; a table of one cell, or a query that meets all, is scanned whole and its result exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.storage import written
from tallyhouse.llm.vectors import dimension_of, lloyd, matrix, sample, valid_rows

PART, CENTRES = 2, 16
#: Queries scanned together.
QUERY_BLOCK = 512
#: Rows scanned together.
SCANNED = 2048
#: Rows that a cell is meant to have, cells at most, rows of a cell that a task codes or scans, and cells that a query meets at first.
CELL, MOST_CELLS, ROWS_PER_TASK, PROBES = 50_000, 4096, 25_000, 8


@dataclass
class Codebook:
    """centres (part, centre, component) and how much more the parallel residual weighs."""

    centres: np.ndarray
    eta: float

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """x as (row, part, component), with zeros added to fill the last of an even number of parts."""
        width = PART * 2 * -(-x.shape[1] // (PART * 2))
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, PART)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (row, part) by coordinate descent on the score-aware loss, one part at a time."""
        p = self.parts(x)
        norm2 = np.maximum((x * x).sum(axis=1), 1e-300)
        half = (self.centres**2).sum(axis=2) / 2
        code = np.stack([(p[:, s] @ self.centres[s].T - half[s]).argmax(axis=1) for s in range(p.shape[1])], axis=1)
        along = np.stack([((p[:, s] - self.centres[s][code[:, s]]) * p[:, s]).sum(axis=1) for s in range(p.shape[1])], axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for s in range(p.shape[1]):
                rest = total - along[:, s]
                r = p[:, s, None, :] - self.centres[s]
                par = (r * p[:, s, None, :]).sum(axis=2)
                loss = (r * r).sum(axis=2) + (self.eta - 1) * (rest[:, None] + par) ** 2 / norm2[:, None]
                code[:, s] = loss.argmin(axis=1)
                along[:, s] = par[np.arange(len(par)), code[:, s]]
                total = rest + along[:, s]
        return code

    @staticmethod
    def learn(x: np.ndarray, threshold: float = 0.2, rounds: int = 4) -> Codebook:
        """Centres from a sample. ``threshold`` T sets the weight of the parallel residual: (d - 1) T^2 / (1 - T^2), one at least: with 25 dimensions or fewer and T = 0.2 both residuals weigh the same."""
        eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        p = Codebook.parts(x)
        found = []
        for s in range(p.shape[1]):
            c = lloyd(p[:, s], CENTRES, rounds=8)
            found.append(np.concatenate([c, np.repeat(c[:1], CENTRES - len(c), axis=0)]))
        book = Codebook(np.stack(found), eta)
        norm2 = np.maximum((x * x).sum(axis=1), 1e-300)
        for _ in range(rounds):
            code = book.codes(x, sweeps=1)
            along = np.stack([((p[:, s] - book.centres[s][code[:, s]]) * p[:, s]).sum(axis=1) for s in range(p.shape[1])], axis=1)
            total = along.sum(axis=1)
            for s in range(p.shape[1]):
                v = p[:, s]
                weight = (eta - 1) / norm2
                a = np.zeros((CENTRES, PART, PART))
                b = np.zeros((CENTRES, PART))
                np.add.at(a, code[:, s], np.eye(PART) + weight[:, None, None] * v[:, :, None] * v[:, None, :])
                np.add.at(b, code[:, s], v + (weight * (total - along[:, s] + (v * v).sum(axis=1)))[:, None] * v)
                used = np.bincount(code[:, s], minlength=CENTRES) > 0
                book.centres[s][used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
                new = ((v - book.centres[s][code[:, s]]) * v).sum(axis=1)
                total += new - along[:, s]
                along[:, s] = new
        return book

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each byte of two codes, what each of its 256 values adds to a query's score: (byte, value, query)."""
        t = np.einsum("qsc,skc->skq", self.parts(q), self.centres)
        return (t[1::2, :, None, :] + t[0::2, None, :, :]).reshape(len(t) // 2, CENTRES * CENTRES, len(q)).astype(np.float32)


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of equals those of the smallest ids."""
    if len(score) > 4 * n:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:n]]


def _distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added in order."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += (x[:, j] - q[j]) ** 2
    return np.sqrt(total)


def nearest_of(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of ``best`` and of the rows (ids, x), of which none is nearer than ``least``: ``first`` rows are measured, then all that may be nearer than the k-th."""
    def joined(best: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        all_ids, all_far = np.concatenate([best[0], ids[at]]), np.concatenate([best[1], _distance(x[at], q)])
        top = _best(-all_far, all_ids, k)
        return all_ids[top], all_far[top]

    start = np.argpartition(least, first)[:first] if len(least) > first else np.arange(len(least))
    start = start[least[start] < np.inf]
    best = joined(best, start)
    bound = best[1][-1] if len(best[1]) == k else np.inf
    rest = (least <= bound) & (least < np.inf)
    rest[start] = False
    at = np.flatnonzero(rest)
    for lo in range(0, len(at), 4096):
        best = joined(best, at[lo : lo + 4096])
    return best


def _nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    far = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)


def _in_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """cell, id, v: each row in its ``n`` nearest cells."""
    if len(centres) == 1:
        return rows.select(F.lit(0).alias("cell"), "id", "v")
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest_cells(matrix(batch.column("v")), shared.value, n)
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), batch.column("id").take(at), batch.column("v").take(at)], names=["cell", "id", "v"])

    return rows.select("id", "v").mapInArrow(assign, "cell int, id long, v array<double>")


def _dealt(rows: DataFrame, per_task: int) -> DataFrame:
    """``rows`` (cell, id, ...) with the part of its cell that a row is in: parts have about ``per_task`` rows, however large the cell."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / per_task).cast("int").alias("parts"))  # a row a cell
    return rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")


def _code(candidates: DataFrame, book) -> DataFrame:
    """A row for some rows of one part of a cell: cell, part and, as bytes, their ids, codes, squared lengths of the codes, distances from them and vectors."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column("cell").to_numpy(), batch.column("part").to_numpy()], axis=1) if batch.num_rows else np.zeros((0, 2))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                some = batch.slice(lo, hi - lo)
                x = matrix(some.column("v"))
                c = book.value.codes(x).astype(np.uint8)
                parts = Codebook.parts(x)
                near = book.value.centres[np.arange(c.shape[1])[None, :], c]
                columns = [np.asarray(some.column("id")).astype("<i8"), c[:, 0::2] | c[:, 1::2] << 4, (near * near).sum(axis=(1, 2)), np.sqrt(((parts - near) ** 2).sum(axis=(1, 2))), x.astype("<f8")]
                yield pa.RecordBatch.from_arrays([some.column("cell")[:1], some.column("part")[:1], *(pa.array([a.tobytes()], pa.binary()) for a in columns)], names=["cell", "part", "ids", "codes", "norm2", "off", "v"])

    dealt = _dealt(candidates, ROWS_PER_TASK).select("cell", "part", "id", "v").repartition(n, "cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(code, "cell int, part int, ids binary, codes binary, norm2 binary, off binary, v binary")


def _asked(queries: DataFrame) -> DataFrame:
    """``queries`` (cell, id, v) in blocks: a row a block of a cell, with its queries' ids and vectors as bytes."""
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vectors, "<f8").tobytes()], pa.binary())], names=["cell", "block", "query_ids", "queries"])

        for batch in batches:
            for cell, part, i, v in zip(*(batch.column(k).to_pylist() for k in ("cell", "part", "id", "v")), strict=True):
                if (cell, part) != key:
                    if key is not None:
                        yield block()
                    key, ids, vectors = (cell, part), [], []
                ids.append(i)
                vectors.append(v)
        if key is not None:
            yield block()

    dealt = _dealt(queries, QUERY_BLOCK).select("cell", "part", "id", "v").repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "id")
    return dealt.mapInArrow(gather, "cell int, block int, query_ids binary, queries binary")


def _scan(coded: DataFrame, asked: DataFrame, book, k: int, rerank: int) -> DataFrame:
    """query_id, id, score: the k nearest rows of each query in each part of the cells that it meets."""
    n = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tables, query_ids, asked, best = None, None, np.zeros(0, np.int64), np.zeros((0, 0)), []

        def result() -> pa.RecordBatch:
            n = [len(b[0]) for b in best]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                *key, ids_, codes, norm2_, off_, v_, qs, vs = (batch.column(c)[row].as_py() for c in ("cell", "block", "part", "ids", "codes", "norm2", "off", "v", "query_ids", "queries"))
                if key != at:
                    if at is not None:
                        yield result()
                    at, query_ids = key, np.frombuffer(qs, "<i8")
                    asked = np.frombuffer(vs, "<f8").reshape(len(query_ids), -1)
                    tables = book.value.tables(asked)
                    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
                every = np.frombuffer(ids_, "<i8")
                for lo in range(0, len(every), SCANNED):
                    part = slice(lo, lo + SCANNED)
                    ids, norm2, off = every[part], np.frombuffer(norm2_, "<f8")[part], np.frombuffer(off_, "<f8")[part]
                    packed = np.frombuffer(codes, np.uint8).reshape(len(every), -1)[part]
                    x = np.frombuffer(v_, "<f8").reshape(len(every), -1)[part]
                    inner = np.zeros((len(ids), len(query_ids)), np.float32)
                    for s in range(packed.shape[1]):
                        inner += tables[s][packed[:, s]]
                    for k_, q in enumerate(query_ids):
                        q2 = (asked[k_] ** 2).sum()
                        # single precision in the tables: what it may be wrong by is added before the root is taken
                        error = 1e-7 * (packed.shape[1] + 4) * (q2 + norm2)
                        least = np.sqrt(np.maximum(q2 - 2 * inner[:, k_].astype(np.float64) + norm2 - error, 0)) - off * (1 + 1e-9)
                        least[~np.isfinite(least)] = 0  # too large for single precision
                        least[ids == q] = np.inf
                        best[k_] = nearest_of(best[k_], asked[k_], x, ids, least, k, rerank)
        if at is not None:
            yield result()

    meet = coded.join(asked, "cell").select("cell", "block", "part", "ids", "codes", "norm2", "off", "v", "query_ids", "queries")
    found = meet.repartition(n, "cell", "block", "part").sortWithinPartitions("cell", "block", "part").mapInArrow(scan, "query_id long, id long, score double")
    order = W.Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(candidates: DataFrame, queries: list, k: int) -> dict[int, list[float]]:
    """The k smallest distances of a few queries from all other rows, by brute force."""
    ids, x = np.array([r["id"] for r in queries]), np.array([r["v"] for r in queries])
    shared = candidates.sparkSession.sparkContext.broadcast((ids, x))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            if batch.num_rows:
                rows, other = matrix(batch.column("v")), batch.column("id").to_numpy()
                for j, q in enumerate(x):
                    far = np.where(other == ids[j], np.inf, _distance(rows, q))
                    best[j] = nearest_of(best[j], q, rows, other, far, k, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), [len(b[1]) for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["place", "score"])

    got = candidates.select("id", "v").mapInArrow(work, "place long, score double").groupBy("place").agg(F.slice(F.sort_array(F.collect_list("score")), 1, k).alias("far")).collect()
    shared.unpersist()
    return {int(ids[r["place"]]): r["far"] for r in got}


def _recall(found: DataFrame, exact: dict[int, list[float]]) -> float:
    """Mean share of the audited queries' nearest rows that are as near as the exact ones."""
    some = found.sparkSession.createDataFrame([(k,) for k in exact], "query_id long")
    got: dict[int, list[float]] = {}
    for r in found.join(F.broadcast(some), "query_id", "left_semi").select("query_id", "score").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    return float(np.mean([sum(s <= far[-1] for s in got.get(q, [])) / len(far) for q, far in exact.items() if far] or [1.0]))


def search(rows: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, rerank: int = 100, learn_from: int = 20_000, recall: float = 0.95, audit: int = 100) -> DataFrame:
    """The ``k`` nearest other rows of each query row: query_id, rank from 1, the neighbour's id and score, its Euclidean distance in double precision.

    ``is_query`` is a condition on the id column. Vectors that are null, empty, zero, of another length than most or not finite in all components take no part, nor do rows without an id;
    fewer candidates than k give fewer rows; ties go to the smaller id. Rows that repeat an id are candidates each; a repeated query id asks with the vector that comes first in order. Extra columns are ignored; an empty table gives an empty one.
    The codebook and centres are fitted on at most ``learn_from`` vectors; every row is coded. In a cell, ``rerank`` rows of a batch are measured first, then all others whose bound the k-th of them does not rule out. Of rows with equal vectors the k + 1 smallest ids stand for all, since no other can be among a query's k nearest.
    A query meets PROBES cells; ``audit`` queries are held against all rows, and below a mean ``recall`` all queries meet twice as many. A ``recall`` above 1 makes every query meet every cell: the result is exact, as it is for a table of one cell.
    """
    spark = rows.sparkSession
    out = f"query_id long, rank int, {id_column} long, score double"
    d = dimension_of(rows, id_column, vector_column)
    if d is None:
        return spark.createDataFrame([], out)
    valid = valid_rows(rows, id_column, vector_column, d)
    queries = written(valid.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "queries")
    learned = sample(valid, learn_from)
    book = spark.sparkContext.broadcast(Codebook.learn(learned))
    alike = W.Window.partitionBy("v").orderBy("id")
    candidates = written(valid.withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    cells = max(1, min(MOST_CELLS, round(candidates.count() / CELL)))
    centres = lloyd(learned, cells)
    coded = written(_code(_in_cells(candidates, centres, 1), book), "codes")
    probes = len(centres) if recall > 1 else min(PROBES, len(centres))
    exact: dict[int, list[float]] = {}
    if probes < len(centres):
        some = queries.orderBy(F.xxhash64("id"), "id").limit(audit).collect()
        exact = _exact(candidates, some, k) if some else {}
    while True:
        found = _scan(coded, written(_asked(_in_cells(queries, centres, probes)), "asked"), book, k, rerank)
        if probes == len(centres):
            break
        found = written(found, "found")
        if _recall(found, exact) >= recall:
            break
        probes = min(2 * probes, len(centres))
    return found.select("query_id", "rank", F.col("id").alias(id_column), "score")
