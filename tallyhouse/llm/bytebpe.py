"""Encoding and decoding of byte-level BPE vocabularies, with long unsplit text joined from its halves.

A text is cut into units that no pre-token spans (white space and what follows it), a unit into pre-tokens by the
vocabulary's own pattern, and a pre-token is merged pair by pair, lowest rank first, the leftmost of equals. What is
longer than a leaf is encoded by halves: the ids around the join are encoded anew in a window that grows until its first
and its last id are those that the left and the right half have there. Then every two neighbours of the result stand
side by side in an encoding already, and a sequence of which that holds is the encoding of the whole: the first merge
across a border would have been made in the encoding of the two neighbours, too.

Texts beyond a block are cut into pieces that tasks encode in parallel; a piece may end within a pre-token, and the joins
of a text's pieces are made in a tree, each in its own window.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from typing import NamedTuple
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.storage import small_batches
from tallyhouse.llm.wordids import byte_letters

#: Characters of a text that one task encodes; bytes of a pre-token that are merged at once, and without an agenda; characters of a unit that the memo keeps.
BLOCK, LEAF, SHORT, MEMO_CHARS = 1 << 16, 256, 32, 100
#: White space as the vocabulary's pattern has it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _AFTER = re.compile(f"[{_WHITE}]"), re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
_UNITS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: The vocabulary's pattern over the first characters of Unicode, whose classes no version of it has changed.
_LETTERS, _NUMBERS = ("".join(re.escape(chr(c)) for c in range(0x250) if category(chr(c))[0] == k) for k in "LN")
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_WHITE}{_LETTERS}{_NUMBERS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BEYOND = re.compile(f"[^{chr(0)}-{chr(0x24F)}]")


class Piece(NamedTuple):
    """Ids of a part of a text, and how many of them its first and its last pre-token have."""

    ids: array
    head: int
    tail: int


class _Memo(dict):
    def __init__(self, fresh: Callable[[str], tuple[bytes, bytes]]):
        self.fresh = fresh

    def __missing__(self, unit: str) -> tuple[bytes, bytes]:
        found = self.fresh(unit)
        if len(unit) <= MEMO_CHARS:
            self[unit] = found
        return found


class ByteBpe:
    """Encoder and decoder for one tokenizer file with a byte-level pre-tokenizer and no normaliser; special tokens are found in texts as the library finds them."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        added = own["added_tokens"]
        split = own["pre_tokenizer"]
        if own["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        vocabulary: dict[str, int] = own["model"]["vocab"]
        byte_of = {c: b for b, c in byte_letters().items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()} | {a["id"]: a["content"].encode() for a in added}
        self.special = {a["content"]: a["id"] for a in added}
        self.longest = max(map(len, self.special), default=0)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.letter = {c: vocabulary[c] for c in byte_of}
        self.letter_of_byte = [vocabulary[c] for _, c in sorted(byte_letters().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(own["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        self.pretokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.rank = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.of_rank = [new for _, new in self.merges.values()]
        self.limit = limit
        # units may hold several pre-tokens, words are one each
        self.units, self.words = _Memo(self._unit), _Memo(self._word)

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges."""
        n, merges = len(symbols), self.merges
        if n <= SHORT:
            return self.merge_short(symbols)
        symbols = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := merges.get((a, b)))]
        heapify(queue)
        # (rank, merged, place, left, right): a rank has one pair, so equal ranks are ordered by place
        while queue:
            _, new, i, a, b = heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heappush(queue, (*m, i, new, symbols[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heappush(queue, (*m, h, symbols[h], new))
        return [s for s in symbols if s >= 0]

    def merge_short(self, symbols: list[int]) -> list[int]:
        """The same, looking at all pairs each time."""
        rank, none = self.rank.get, len(self.of_rank)
        symbols = list(symbols)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = self.of_rank[best]
            symbols[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = rank((new, symbols[i + 1]), none)
        return symbols

    def again(self, ids: array | list[int]) -> list[int]:
        """The encoding of what ids stand for, as one pre-token without halves."""
        letters = self.letter_of_byte
        return self.merge([letters[b] for i in ids for b in self.bytes_of[i]])

    def join(self, left: array, right: array) -> array:
        """Ids of a pre-token from those of its two parts."""
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(k, len(right))
            window = self.again(left[a:] + right[:b])
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + array("I", window) + right[b:]
            k *= 2

    def pretoken(self, letters: str) -> array:
        """Ids of a pre-token, given as its bytes' letters; one beyond a leaf is joined from its halves."""
        n = len(letters)
        if n <= LEAF:
            return array("I", self.merge([self.letter[c] for c in letters]))
        return self.join(self.pretoken(letters[: n // 2]), self.pretoken(letters[n // 2 :]))

    def _unit(self, unit: str) -> tuple[bytes, bytes]:
        """Ids of a unit as little-endian unsigned 32-bit integers, and the bytes that these ids stand for."""
        ids = array("I")
        for letters, _ in self.pretokens(unit):
            ids += self.pretoken(letters)
        return ids.tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _word(self, word: str) -> tuple[bytes, bytes]:
        raw = word.encode()
        ids = array("I", self.merge([self.letter_of_byte[b] for b in raw])) if len(raw) <= LEAF else self.pretoken(self.pretokens(word)[0][0])
        return ids.tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """The units of a text in turn, special tokens as units of their own."""
        if self.specials is None or not any(s in text for s in self.special):
            if _BEYOND.search(text):
                return list(map(self.units.__getitem__, _UNITS.findall(text)))
            return list(map(self.words.__getitem__, _PRETOKENS.findall(text)))
        out = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                out.append((array("I", [self.special[part]]).tobytes(), part.encode()))
            else:
                out.extend(map(self.units.__getitem__, _UNITS.findall(part)))
        return out

    def trim(self) -> None:
        """Empty a memo when the two have grown past the limit; between texts only."""
        if len(self.units) + len(self.words) > self.limit:
            max(self.units, self.words, key=len).clear()

    def encode(self, text: str | None) -> array:
        """Ids of a text."""
        self.trim()
        return array("I", b"".join([p[0] for p in self.parts(text or "")]))

    def decode(self, ids: array | list[int]) -> str:
        """Text of ids; special tokens have their text, and bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def kind(self, c: str) -> str:
        """The class of a character in the vocabulary's pattern: L letter, N number, S white space, P other."""
        if _SPACE.match(c):
            return "S"
        return next((k for k, p in (("L", "abc"), ("N", "1")) if len(self.pretokens(p + c)) == 1), "P")

    def cut(self, text: str, p: int) -> str | None:
        """Whether a text can be cut before place ``p``: ``closed`` where a pre-token always ends, ``open`` within one of which both sides, apart, keep a part each."""
        near = text[max(0, p - self.longest) : p + self.longest]
        if any(s in near for s in self.special):
            return None
        a, b = text[p - 1], text[p]
        left, right = self.kind(a), self.kind(b)
        if left == "S" or right == "S":
            if left != "S":
                return "closed"
            return "open" if right == "S" and self.kind(text[p + 1 : p + 2] or "x") == "S" else None
        if left != right:
            return None if a == "'" and right == "L" else "closed"
        if left == "L":  # three letters: the last of them is in no shortened word after an apostrophe
            return "open" if p >= 3 and self.kind(text[p - 2]) == self.kind(text[p - 3]) == "L" else None
        return None if b == "'" else "open"

    def cuts(self, text: str, block: int) -> Iterator[tuple[int, int, bool]]:
        """Pieces of about ``block`` characters: begin, end, and whether the cut before it is an open one."""
        at, opened, n = 0, False, len(text)
        while n - at > block + block // 2:
            white = _AFTER.search(text, at + block, min(n, at + block + block // 8))
            p = white.start() if white and self.cut(text, white.start()) else at + block
            while p < n and not (found := self.cut(text, p)):
                p += 1
            if p == n:
                break
            yield at, p, opened
            at, opened = p, found == "open"
        yield at, n, opened

    def piece(self, text: str) -> Piece:
        """The encoding of a part of a text that begins and ends at cuts."""
        ids, counts = array("I"), []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            for letters, _ in self.pretokens(part) if k % 2 == 0 else ():
                own = self.pretoken(letters)
                counts.append(len(own))
                ids += own
            if k % 2:
                ids.append(self.special[part])
                counts.append(1)
        return Piece(ids, counts[0] if counts else 0, counts[-1] if counts else 0)

    def joined(self, pieces: list[tuple[bool, Piece]]) -> Piece:
        """Neighbouring pieces as one, in a tree; with each whether the cut before it is open."""
        if len(pieces) == 1:
            return pieces[0][1]
        half = len(pieces) // 2
        opened, left, right = pieces[half][0], self.joined(pieces[:half]), self.joined(pieces[half:])
        if not opened or not left.ids or not right.ids:
            ends = left.head if left.ids else right.head, right.tail if right.ids else left.tail
            return Piece(left.ids + right.ids, *ends)
        first, last = len(left.ids) - left.tail, right.head
        middle = self.join(left.ids[first:], right.ids[:last])
        head = left.head if first else len(middle)
        tail = right.tail if last < len(right.ids) else len(middle)
        return Piece(left.ids[:first] + middle + right.ids[last:], head, tail)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for this tokenizer file."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, ids: bool = True, digests: bool = False, block: int = BLOCK) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per row of ``docs``: doc_id, n_tokens, with ``ids`` the ids and ``decoded`` their text, with ``digests``
    SHA-256 of both (ids as little-endian unsigned 32-bit integers) instead. A null text is empty and has no id. Repeated
    rows stay; an empty table gives an empty one; extra columns, whatever their names, do not matter.
    Texts up to ``block`` characters stay in their task. Longer ones are cut into pieces, dealt over the tasks, encoded and
    joined; only these are shuffled, and the most that a task holds is one text's ids.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_tokens long" + ", ids array<long>, decoded string" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    short = rows.where(F.length("text") <= block).mapInArrow(partial(_whole, path=path, ids=ids, digests=digests), result)
    cut = rows.where(F.length("text") > block).mapInArrow(partial(_cut, path=path, block=block), f"doc_id {kind}, text_sha256 string, block int, opened boolean, piece string")
    leaves = cut.repartition("doc_id", "text_sha256", "block").mapInArrow(partial(_leaves, path=path), f"doc_id {kind}, text_sha256 string, block int, opened boolean, ids binary, head long, tail long")
    by_text = leaves.repartition("doc_id", "text_sha256").sortWithinPartitions("doc_id", "text_sha256", "block")
    return short.union(by_text.mapInArrow(partial(_assembled, path=path, ids=ids, digests=digests, kind=kind), result))


def _columns(doc_id: pa.Array, encoded: list[bytes], decoded: list[bytes], ids: bool, digests: bool) -> pa.RecordBatch:
    columns = {"doc_id": doc_id, "n_tokens": pa.array([len(e) // 4 for e in encoded], pa.int64())}
    if ids:
        columns |= {"ids": pa.array([array("I", e).tolist() for e in encoded], pa.list_(pa.int64())), "decoded": pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())}
    if digests:
        columns |= {"ids_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def _whole(batches: Iterator[pa.RecordBatch], path: str, ids: bool, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(path)
    for batch in batches:
        encoded, decoded = [], []
        for text in batch.column(1).to_pylist():
            bpe.trim()
            parts = bpe.parts(text)
            encoded.append(b"".join([p[0] for p in parts]))
            decoded.append(b"".join([p[1] for p in parts]))
        yield _columns(batch.column(0), encoded, decoded, ids, digests)


def _cut(batches: Iterator[pa.RecordBatch], path: str, block: int) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(path)
    for batch in batches:
        for k in range(len(batch)):
            text = batch.column(1)[k].as_py()
            digest = hashlib.sha256(text.encode()).hexdigest()
            for place, (begin, end, opened) in enumerate(bpe.cuts(text, block)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(k, 1), "text_sha256": [digest], "block": pa.array([place], pa.int32()), "opened": [opened], "piece": [text[begin:end]]})


def _leaves(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(path)
    for batch in batches:
        found = [bpe.piece(t) for t in batch.column(4).to_pylist()]
        columns = {batch.schema.names[k]: batch.column(k) for k in range(4)}
        yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array([p.ids.tobytes() for p in found], pa.binary()), "head": pa.array([p.head for p in found], pa.int64()), "tail": pa.array([p.tail for p in found], pa.int64())})


def _assembled(batches: Iterator[pa.RecordBatch], path: str, ids: bool, digests: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """Pieces come text by text in order; those of equal rows come together, and are joined once."""
    bpe = byte_bpe(path)
    own: tuple | None = None
    pieces: list[tuple[bool, Piece]] = []
    copies = 0

    def told() -> Iterator[pa.RecordBatch]:
        if own is not None:
            found = bpe.joined(pieces).ids
            decoded = b"".join(map(bpe.bytes_of.__getitem__, found))
            for _ in range(copies):
                yield _columns(doc_id, [found.tobytes()], [decoded], ids, digests)

    for batch in batches:
        for k, row in enumerate(batch.select(["text_sha256", "block", "opened", "ids", "head", "tail"]).to_pylist()):
            key = batch.column(0)[k].as_py(), row["text_sha256"]
            if key != own:
                yield from told()
                own, pieces, copies, doc_id = key, [], 0, pa.concat_arrays([batch.column(0).slice(k, 1)])
            if row["block"] == 0:
                copies += 1
            if row["block"] == len(pieces):
                pieces.append((row["opened"], Piece(array("I", row["ids"]), row["head"], row["tail"])))
    yield from told()
