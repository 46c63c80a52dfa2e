"""Document quality by attention over passages: multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its words, by a learned embedding of each bucket of their hashes, and from
counts of its characters and shapes; gated attention, learned from the labels of
documents alone, weighs the passages; the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.jaccard import _slices
from tallyhouse.llm.language import held_out
from tallyhouse.llm.shingles import word_hashes
from tallyhouse.llm.storage import small_batches, written

#: Words of a passage, and buckets that their hashes fall into.
PASSAGE, BUCKETS = 64, 256
#: Byte classes counted in words.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "loud": b"!?",
    "symbol": b"#$%&*@^~|<>{}[]\\/=+_`",
    "other": bytes(range(128, 256)),
}
#: How strongly embeddings are drawn to zero, where they start: a word must earn its weight.
EMBEDDING_DECAY = 5e-3
FEATURES = [*(f"{k}_share" for k in _CLASSES), "word_length", "upper_words", "symbol_words", "loud_words", "stop_words", "single_words", "same_as_last", "distinct", "capitalised", "new_lines", "full"]
WIDTH = len(FEATURES) + BUCKETS


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passage, feature) of all passages in order, and how many passages each text has: one at least. After FEATURES comes the root of each bucket's share of the words."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    begins, hashes = word_hashes(buf)
    cut = np.searchsorted(begins, np.append(starts, len(buf) + 1))
    words = np.diff(cut)
    passages = np.maximum(1, -(-words // PASSAGE))
    out = np.zeros((int(passages.sum()), WIDTH))
    if not len(begins):
        return out, passages
    table = np.zeros(256, np.uint8)
    for k, c in enumerate(_CLASSES.values(), 1):
        table[list(c)] = k
    kind = table[buf]
    gap = np.isin(buf, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    spaces = np.concatenate([[0], np.cumsum(gap)])
    ends = np.append(begins[1:], len(buf))
    ends = ends - (spaces[ends] - spaces[begins])  # what lies between a word's begin and the next is the word and gaps
    length = ends - begins
    count = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[np.append(begins, len(buf))]) for k in range(1, len(_CLASSES) + 1)], axis=1)
    upper, lower, _, stop, loud, symbol, other = count.T
    first_upper = table[buf[begins]] == 1
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    new_line = np.diff(lines[np.append(begins, len(buf))]) > 0
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    doc = np.repeat(np.arange(len(raw)), words)
    first_passage = np.concatenate([[0], np.cumsum(passages)[:-1]])
    at = first_passage[doc] + (np.arange(len(begins)) - cut[:-1][doc]) // PASSAGE
    order = np.lexsort((hashes, at))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (at[order][1:] != at[order][:-1])
    n = np.bincount(at, minlength=len(out))
    some = np.maximum(n, 1)
    letters = np.maximum(np.bincount(at, length, len(out)), 1)
    rows = [*(np.bincount(at, c, len(out)) / letters for c in count.T), np.bincount(at, length, len(out)) / some / 10]
    rows += [np.bincount(at, w, len(out)) / some for w in ((upper > 0) & (lower == 0) & (length > 1), symbol > 0, loud > 0, stop > 0, length == 1, same)]
    rows += [np.bincount(at[order], fresh, len(out)) / some, np.bincount(at, first_upper, len(out)) / some, np.bincount(at, new_line, len(out)) / some, np.minimum(n, PASSAGE) / PASSAGE]
    out[:, : len(FEATURES)] = np.stack(rows, axis=1)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    out[:, len(FEATURES) :] = np.sqrt(np.bincount(at * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS) / some[:, None])
    return out, passages


class Attention:
    """p = sigmoid(w z + b), z = sum over passages of a h, h = tanh(x W + c), a = softmax(u (tanh(h V) * sigmoid(h U))). The rows of W that belong to buckets are the embeddings of their words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7, hidden: int = 16, gates: int = 8):
        random = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = {"W": random.normal(0, d**-0.5, (d, hidden)), "c": np.zeros(hidden), "V": random.normal(0, 0.25, (hidden, gates)), "U": random.normal(0, 0.25, (hidden, gates)), "u": random.normal(0, 0.25, gates), "w": random.normal(0, 0.25, hidden), "b": np.zeros(1)}

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean.astype(x.dtype)
        x /= self.scale
        return np.clip(x, -8, 8, out=x)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` is in standard form."""
        w, start = self.w, np.concatenate([[0], np.cumsum(bags)[:-1]])
        of = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ w["W"].astype(x.dtype) + w["c"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["u"]
        a = np.exp(e - np.maximum.reduceat(e, start)[of])
        a /= np.add.reduceat(a, start)[of]
        z = np.add.reduceat(a[:, None] * h, start)
        p = 1 / (1 + np.exp(-np.clip(z @ w["w"] + w["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "of": of, "start": start}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, decay: float = 1e-4) -> dict[str, np.ndarray]:
        w, n = self.w, len(y)
        ds = (f["p"] - y) / n
        dz = ds[:, None] * w["w"]
        da = (f["h"] * dz[f["of"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["start"])[f["of"]])
        dt, dg = de[:, None] * w["u"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[f["of"]] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        out = {"W": f["x"].T @ dh.astype(f["x"].dtype), "c": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "u": (f["t"] * f["g"]).T @ de, "w": f["z"].T @ ds, "b": ds.sum(keepdims=True)}
        return {k: v + decay * w[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.02) -> Attention:
        x, words = self.standard(x), slice(len(FEATURES), None)
        self.w["W"][words] = 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            gradients = self.gradients(self.forward(x, bags), y)
            gradients["W"][words] += EMBEDDING_DECAY * self.w["W"][words]
            for k, g in gradients.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 200_000, passages: int = 60_000) -> Attention | None:
    """Learn from at most ``sample`` labelled documents outside the held-out fold, those of the lowest hashes of doc_id, none longer than ``longest`` characters.

    Of these, as many as have ``passages`` passages in all come to the driver, in order of that hash: 66 MB of single-precision features, whatever the corpus.
    Rows of a document that contradict each other count as their highest label. None if there are not two kinds of label.
    """
    small_batches(docs.sparkSession)
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in _slices(texts):
                x, bags = passage_features(texts[s])
                parts = np.split(x.astype("<f4"), np.cumsum(bags)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], batch.column(2)[s.start : s.stop], pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "quality", "x"])

    texts = docs.where((F.coalesce(F.length("text"), F.lit(0)) <= longest) & ~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    encoded = written(texts.select("doc_id", "text", "quality").mapInArrow(work, "doc_id long, quality double, x binary"), "passages")
    place = F.xxhash64("doc_id")
    sizes = encoded.groupBy(place.alias("place")).agg((F.sum(F.length("x")) / (4 * WIDTH)).alias("n")).orderBy("place").collect()  # a row a sampled document
    fits = np.cumsum([r["n"] for r in sizes]) <= passages
    if not fits.any():
        return None
    rows = encoded.where(place <= sizes[int(fits.sum()) - 1]["place"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows]
    x, bags = np.concatenate(parts), np.array([len(p) for p in parts])
    del rows, parts
    return Attention(x.mean(axis=0, dtype=np.float64), np.array([c.std(dtype=np.float64) for c in x.T]) + 0.02).fit(x, bags, y)


def score(docs: DataFrame, model: Attention | None) -> DataFrame:
    """``docs`` with quality_score added: how likely label 1 is, from every passage of the whole text.

    A null or empty text is one passage without words and is scored like any other. Without a model every score is 0.5. Repeated rows stay; other columns pass through
    untouched, and only text is read; a column called quality_score is replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found: list[np.ndarray] = []
            for s in _slices(texts):
                x, bags = passage_features(texts[s])
                found.append(np.full(len(bags), 0.5) if model is None else model.forward(model.standard(x), bags)["p"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(work, schema)
