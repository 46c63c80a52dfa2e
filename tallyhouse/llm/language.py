"""Language identification by unigram pieces, summed over every segmentation of a word.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece, learned by expectation
maximisation from labelled texts; a word's probability is the sum over all ways to cut it into pieces, by the forward algorithm,
and a text's is the product over its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.storage import small_batches, written

#: Probability of a letter that no piece has, for any language.
UNKNOWN = 1e-8
#: Positions after which sums are scaled again, so that none leaves the range of doubles.
BLOCK = 16
#: Words in a worker's memo, numbers in its table at most, and letters of the longest word that it keeps.
MEMO_WORDS, MEMO_NUMBERS, MEMO_LETTERS = 500_000, 20_000_000, 64
#: Letters of words that are segmented together; a longer word is alone.
TOGETHER = 1 << 18
UNDETERMINED = "und"
_RUNS = regex.compile(r"\p{L}+")
_PRIME = np.uint64(0x100000001B3)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the pieces in ascending order, the piece of each, and the length of the longest."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    hashes = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        h = 0
        for c in t:
            h = (h * int(_PRIME) + ord(c) + 1) & (1 << 64) - 1
        hashes[k] = h
    order = np.argsort(hashes)
    return hashes[order], order, max(map(len, texts))


class Lattice:
    """All pieces in some words: for each piece length, the piece that begins at each letter, or -1."""

    def __init__(self, words: list[str], path: str):
        hashes, order, longest = _vocabulary(path)
        self.lengths = np.array([len(w) for w in words])
        self.n, self.width = int(self.lengths.max()), len(words)
        codes = np.frombuffer("".join(w.ljust(self.n, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(self.width, self.n).astype(np.uint64) + np.uint64(1)
        self.pieces: dict[int, np.ndarray] = {}
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]  # lengths of the pieces that end at a position, in any of the words
        rolled = np.zeros_like(codes)
        for size in range(1, min(longest, self.n) + 1):
            rolled = rolled[:, : self.n - size + 1] * _PRIME + codes[:, size - 1 :]
            k = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            self.pieces[size] = piece = np.where(hashes[k] == rolled, order[k], -1).astype(np.int32).T.copy()
            for begin in range(self.n - size + 1) if size == 1 else np.flatnonzero((piece >= 0).any(axis=1)).tolist():
                self.ending[begin + size].append(size)

    def _probability(self, table: np.ndarray, end: int, size: int) -> np.ndarray:
        piece = self.pieces[size][end - size]
        return np.where((piece >= 0)[:, None], table[piece], UNKNOWN if size == 1 else 0.0)

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations up to each position (position, word, language), divided by e to the scale of its block, and these scales (block, word, language)."""
        sums = np.zeros((self.n + 1, self.width, table.shape[1]))
        scale = np.zeros((self.n // BLOCK + 1, self.width, table.shape[1]))
        sums[0] = 1
        for end in range(1, self.n + 1):
            block = (end - 1) // BLOCK
            for size in self.ending[end]:
                before = sums[end - size] * self._probability(table, end, size)
                other = (end - size) // BLOCK
                sums[end] += before if other == block else before * np.exp(scale[other] - scale[block])
            if end % BLOCK == 0:
                scale[block + 1] = scale[block] + np.log(sums[end])
                sums[end] = 1
        return sums, scale

    def logs(self, table: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language: words may differ in length."""
        sums, scale = self.forward(table)
        at = np.arange(self.width)
        return np.log(sums[self.lengths, at]) + scale[self.lengths // BLOCK, at]

    def expected(self, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts (piece, language) of words of one length that come ``weight`` (word, language) times."""
        sums, scale = self.forward(table)
        counts = np.zeros_like(table)
        # what follows each position, divided by e to the word's logarithm less the scale of the position's block
        after = np.zeros_like(sums)
        after[self.n] = 1 / sums[self.n]
        for end in range(self.n, 0, -1):
            for size in self.ending[end]:
                p = self._probability(table, end, size)
                here, before = end // BLOCK, (end - size) // BLOCK
                onward = after[end] * p if here == before else after[end] * p * np.exp(scale[before] - scale[here])
                after[end - size] += onward
                piece = self.pieces[size][end - size]
                use = piece >= 0
                np.add.at(counts, piece[use], (sums[end - size] * onward * weight)[use])
        return counts


def _alike(words: list[str], same_length: bool = False) -> Iterator[tuple[list[int], list[str]]]:
    """Words in groups of about one length, or of the very same: their places and themselves."""
    lengths: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        n = len(w)
        lengths.setdefault(n if same_length or n <= 24 else -int(np.log2(n) * 6), []).append(k)
    for ks in lengths.values():
        most = max(len(words[k]) for k in ks)
        step = max(1, min(4096, TOGETHER // most))
        for lo in range(0, len(ks), step):
            yield ks[lo : lo + step], [words[k] for k in ks[lo : lo + step]]


def letters(text: str) -> list[str]:
    """Runs of letters, lower case: what is segmented, in learning and prediction alike."""
    return _RUNS.findall(text.lower())


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, sample_per_language: int = 600, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece in each (piece, language).

    Learned from text and non-null lang of rows outside the held-out fold: about ``sample_per_language`` rows of each
    language, those of the lowest hashes of doc_id; all words of a sampled text count.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    hashes = _vocabulary(path)[0]
    if not langs:
        return [], np.zeros((len(hashes), 0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample_per_language / n) * (1 << 30)).cast("long")) for k, n in sizes.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in letters(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    small_batches(docs.sparkSession)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("lang", "text")
    words = written(chosen.mapInArrow(cut, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("count")), "words")
    column = {k: i for i, k in enumerate(langs)}
    table = np.full((len(hashes), len(langs)), 1.0 / len(hashes))

    def gather(table: np.ndarray):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros_like(table)
            for frame in frames:
                lang, n = np.array([column[x] for x in frame["lang"]]), frame["count"].to_numpy()
                for ks, same in _alike(["▁" + w for w in frame["word"]], same_length=True):
                    weight = np.zeros((len(ks), len(langs)))
                    weight[np.arange(len(ks)), lang[ks]] = n[ks]
                    counts += Lattice(same, path).expected(table, weight)
            piece, lang = np.nonzero(counts > 1e-6)
            yield pd.DataFrame({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": counts[piece, lang]})

        return work

    for _ in range(rounds):
        got = words.mapInPandas(gather(table), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages at most
        counts = np.zeros_like(table)
        counts[got["piece"], got["lang"]] = np.round(got["n"], 6)
        table = (counts + 0.01) / (counts.sum(axis=0) + 0.01 * len(counts))
    return langs, table


class Scorer:
    """Log probabilities of words in each language, each word's computed once a worker."""

    def __init__(self, langs: list[str], table: np.ndarray, path: str):
        self.langs, self.table, self.path = langs, table, path
        self.limit = min(MEMO_WORDS, MEMO_NUMBERS // max(1, len(langs)))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores, self.used = np.zeros((1024, len(self.langs))), 1  # row 0: no letters

    def learn(self, words: list[str]) -> None:
        """Rows for new words: the sum over the runs of letters in each, every run after the mark that begins words."""
        runs = [["▁" + r for r in letters(w)] for w in words]
        parts = list({r for rs in runs for r in rs})
        of: dict[str, np.ndarray] = {}
        for _, some in _alike(parts):
            of.update(zip(some, Lattice(some, self.path).logs(self.table), strict=True))
        while self.used + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for w, rs in zip(words, runs, strict=True):
            if not rs:
                self.row[w] = 0
                continue
            self.scores[self.used] = sum(of[r] for r in rs)
            self.row[w] = self.used
            self.used += 1

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.row) > self.limit:
            self.clear()
        row = self.row
        words = [(t or "").lower().split() for t in texts]
        missing = {w for ws in words for w in ws if w not in row}
        long = [w for w in missing if len(w) > MEMO_LETTERS]
        self.learn([w for w in missing if len(w) <= MEMO_LETTERS])
        kept = self.used
        self.learn(long)
        names, best = [], []
        for ws in words:
            rows = np.fromiter(map(row.__getitem__, ws), np.int64, len(ws))
            if not self.langs or not rows.any():
                names.append(UNDETERMINED)
                best.append(0.0)
                continue
            total = self.scores[rows].sum(axis=0)
            p = np.exp(total - total.max())
            k = int(p.argmax())
            names.append(self.langs[k])
            best.append(float(p[k] / p.sum()))
        for w in long:
            del row[w]
        self.used = kept
        return names, best


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score added: the likeliest learned language of each whole text and its probability, all languages being as likely before.

    Null texts and those without a letter, and every text if nothing could be learned, are ``und`` with score 0. Of equally likely languages the first in
    alphabetical order counts. Repeated rows stay; other columns pass through untouched, and only text is read; columns called lang_pred or score are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(*shared.value, path)
        for batch in batches:
            names, best = _SCORERS[name].score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(work, schema)
