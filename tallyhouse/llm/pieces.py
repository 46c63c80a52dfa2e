"""SentencePiece encoding and decoding of merge-type vocabularies.

A score-ordered agenda of adjacent symbol pairs merges the best pair first, the leftmost of equals.
No merge can join two characters that stand side by side in no piece, so a text falls apart at such
places into short segments; each distinct segment is encoded once a worker and kept in a bounded memo.
Whatever is encoded for the first time in an Arrow batch is checked against the sentencepiece library
before the batch goes on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import small_batches

SPACE = "▁"
_CHUNKS = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """Encoder and decoder for one model file of the merge type with an identity normaliser."""

    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.eos, self.unk, self.limit = lib.eos_id(), lib.unk_id(), limit
        self.text: list[str] = [lib.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)}
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(n) if i not in self.special and i not in self.byte_of]
        self.id_of = {self.text[i]: i for i in normal}
        self.rank = {self.text[i]: -lib.get_score(i) for i in normal}
        self.adjacent = {t[k : k + 2] for t in self.id_of for k in range(len(t) - 1)}
        self.words: dict[str, tuple[str, str]] = {}
        self.segments: dict[str, tuple[str, str]] = {}

    def agenda(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment."""
        n, rank = len(segment), self.rank
        symbol, after, before = list(segment), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[p], i, p) for i in range(n - 1) if (p := segment[i : i + 2]) in rank]
        heapify(queue)
        while queue:
            _, i, piece = heappop(queue)
            j = after[i]
            if not symbol[i] or j >= n or symbol[i] + symbol[j] != piece:
                continue
            symbol[i], symbol[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbol[k]) in rank:
                    heappush(queue, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := symbol[h] + piece) in rank:
                heappush(queue, (rank[p], h, p))
        ids: list[int] = []
        for s in symbol:
            if s:
                i = self.id_of.get(s)
                if i is not None:
                    ids.append(i)
                elif self.byte_id:
                    ids.extend(self.byte_id[b] for b in s.encode())
                else:
                    ids.append(self.unk)
        return tuple(ids)

    def chunk(self, chunk: str) -> tuple[str, str, bool]:
        """Ids of a chunk as text, what they decode to, and whether the agenda had to work: the chunk's segments
        between places that no piece spans, each from the memo or the agenda."""
        adjacent, memo, at, found, new = self.adjacent, self.segments, 0, [], False
        for k in range(1, len(chunk) + 1):
            if k == len(chunk) or chunk[k - 1 : k + 1] not in adjacent:
                segment = chunk[at:k]
                known = memo.get(segment)
                if known is None:
                    ids = self.agenda(segment)
                    known = memo[segment] = (" ".join(map(str, ids)), self.pieces_text(ids))
                    new = True
                found.append(known)
                at = k
        if len(found) == 1:
            return (*found[0], new)
        return " ".join([f[0] for f in found]), "".join([f[1] for f in found]), new

    def chunks(self, text: str) -> list[str]:
        """The text cut before each run of spaces, with the leading space that the format adds. A chunk after one space leaves it out."""
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] if c[0] == SPACE and c[1:2] not in (SPACE, "") else c for c in _CHUNKS.findall(SPACE + text.replace(" ", SPACE))]

    def trim(self) -> None:
        """Empty a memo that has grown past the limit; between batches only."""
        for memo, limit in ((self.words, self.limit), (self.segments, 2 * self.limit)):
            if len(memo) > limit:
                memo.clear()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not in the memo; those with new segments are checked against the library in one call."""
        plain, line = [], []
        for c in chunks:
            if c[0] == SPACE:
                ids, text, new = self.chunk(c)
                if new and len(c) > 1 and ids != " ".join(map(str, self.library.encode(c[1:].replace(SPACE, " ")))):
                    raise AssertionError(f"the agenda and the sentencepiece library differ: {c!r}")
            else:
                ids, text, new = self.chunk(SPACE + c)
                if new:
                    plain.append(c)
                    line.append(ids)
            self.words[c] = ids, text
        if plain and " ".join(line) != " ".join(map(str, self.library.encode(" ".join(plain)))):
            raise AssertionError("the agenda and the sentencepiece library differ")

    def pieces_text(self, ids: list[int]) -> str:
        """What ids stand for, spaces that the format adds included. Bytes that are no UTF-8 become U+FFFD each."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if i not in self.special:
                out.append(self.text[i].replace(SPACE, " "))
            elif i == self.unk:
                out.append(" ⁇ ")
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without an end id."""
        if not text:
            return []
        self.trim()
        chunks = self.chunks(text)
        if missing := {c for c in chunks if c not in self.words}:
            self.learn(missing)
        return [int(i) for c in chunks for i in self.words[c][0].split()]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids have none."""
        text = self.pieces_text(ids)
        first = next((i for i in ids if i not in self.special or i == self.unk), self.unk)
        return text[1:] if self.text[first].startswith(SPACE) else text


def _utf8(raw: bytearray) -> str:
    out, k = [], 0
    while k < len(raw):
        size = 1 if raw[k] < 0x80 else 2 if raw[k] >> 5 == 6 else 3 if raw[k] >> 4 == 14 else 4 if raw[k] >> 3 == 30 else 0
        try:
            if not size:
                raise ValueError
            out.append(bytes(raw[k : k + size]).decode())
            k += size
        except ValueError:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's encoder for this model file."""
    return Pieces(path)


def encode(docs: DataFrame, path: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per row of ``docs``: doc_id, n_tokens (an end id included), with ``ids`` the ids
    and ``decoded`` their text, with ``digests`` SHA-256 of both instead. A null text is empty and has the end id
    only. Repeated rows stay; an empty table gives an empty one; extra columns, whatever their names, do not matter.
    Texts go through in Arrow batches, whole; a worker holds one batch and a bounded memo.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            p.trim()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [p.chunks(t) if t else [] for t in texts]
            words = p.words
            missing = {c for chunks in cut for c in chunks if c not in words}
            if missing:
                p.learn(missing)
            n, joined, decoded = [], [], []
            for chunks in cut:
                found = [words[c] for c in chunks]
                line = " ".join([w[0] for w in found] + [str(p.eos)])
                text = "".join([w[1] for w in found])
                n.append(line.count(" ") + 1)
                joined.append(line)
                decoded.append(text[1:] if text.startswith(" ") else text)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if ids:
                columns |= {"ids": pa.array([[int(i) for i in line.split()] for line in joined], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            if digests:
                columns |= {"ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]), "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>, decoded string" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(work, schema)
