"""Rules by the million: texts and rules are dealt by words that the rules' patterns need, so that no task holds all rules.

A pattern is read for words that each of its matches must hold one of. The words that fewest rules share stand for a rule;
their hashes are the keys of a join with those of the places in a text where one of all the words may begin. Patterns
are tried only where a word was found: by Spark's engine, if it reads them as Python's does, else by Python's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter
from re import _parser as parser  # the pattern as a tree; there is no other public reader of it

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.folders import stored

#: Letters that a word must have to be worth looking for; words that letters with a choice may spell; rules that may share their rarest word, beside what chance puts together; compiled patterns that a task keeps.
LEAST_LETTERS, MOST_WORDS, MOST_SHARING, MOST_COMPILED = 2, 16, 1000, 10_000
#: Letters that patterns take for one of a-z, whatever the case.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
#: Fixed value: after a word, that no letter, digit or underscore follows.
EDGE = "\b"
#: Letters of a word that make its key; bytes of texts that are hashed at once; bits of a key that count words and that say which keys there are.
KEY_LETTERS, PIECE, COUNT_BITS, FILTER_BITS = 24, 1 << 20, 20, 28

#: Letters for private use stand for the digits of a pattern where only these tell it from others.
_CODES = range(0xE000, 0xF8FF)
_STANDING = "".join(map(chr, _CODES))
_IS_WORD = re.compile(f"[A-Za-z0-9_{_STANDING[0]}-{_STANDING[-1]}]")
#: What stands between words, between sets of them and before all sets.
_UNIT, _SET, _GROUP = "\x1f", "\x1e", "\x1d"
_DIGITS, _NOT_DIGITS = re.compile("[0-9]+"), re.compile(r"[{]|\(\?\(|\\[0-9xuUN]|[^\x00-\x7f]")
_REPEATS = (parser.MAX_REPEAT, parser.MIN_REPEAT)


def needed(pattern: str) -> list[set[str]]:
    """Sets of words in lower case: every text that ``pattern`` matches holds at least one word of each set; one with EDGE behind it where no letter, digit or underscore follows."""
    return _all_needed(parser.parse(pattern, re.IGNORECASE))


def _all_needed(tree) -> list[set[str]]:
    return _needed(tree, not tree.state.flags & re.ASCII)  # with that flag a word may end before a letter of ALIKE


def _needed(items, edges: bool) -> list[set[str]]:
    found: list[set[str]] = []
    _ended(_read(items, {""}, found, edges), found)
    return found


def _ended(runs: set[str], found: list[set[str]]) -> None:
    if min(len(run.rstrip(EDGE)) for run in runs) >= LEAST_LETTERS:
        found.append(runs)


def _letters(op, value) -> list[str]:
    codes = [value] if op is parser.LITERAL else [v for _, v in value] if op is parser.IN and all(o is parser.LITERAL for o, _ in value) else []
    return [chr(v).lower() for v in codes] if codes and all(v < 128 or v in _CODES for v in codes) and ord(EDGE) not in codes else []


def _spelled(branches) -> set[str]:
    """What ``branches`` of letters alone spell; nothing if that is too much, or if there is anything else in them."""
    spelled: set[str] = set()
    for branch in branches:
        words = {""}
        for op, value in branch:
            letters = _letters(op, value)
            words = {word + letter for word in words for letter in letters} if len(words) * len(letters) <= MOST_WORDS else set()
        if not words:
            return set()
        spelled |= words
    return spelled


def _read(items, runs: set[str], found: list[set[str]], edges: bool) -> set[str]:
    """Reads on after ``runs``, what the letters read last may spell, and returns what they spell then."""
    for op, value in items:
        more = _spelled(value[1]) if op is parser.BRANCH else _letters(op, value)
        if more and len(runs) * len(more) <= MOST_WORDS:
            runs = {run.rstrip(EDGE) + letters for run in runs for letters in more}
        elif op is parser.AT:  # a place, not a letter
            if edges and value is parser.AT_BOUNDARY and all(_IS_WORD.match(run.rstrip(EDGE)[-1:]) for run in runs):
                runs = {run.rstrip(EDGE) + EDGE for run in runs}
        elif op is parser.SUBPATTERN and not value[1] and not value[2]:
            runs = _read(value[3], runs, found, edges)
        elif op in _REPEATS and len(value[2]) == 1 and (again := _letters(*value[2][0])):
            last = {run.rstrip(EDGE)[-1:] for run in runs}
            if value[0] and len(runs) * len(again) <= MOST_WORDS:
                runs = {run.rstrip(EDGE) + letter for run in runs for letter in again}
            _ended(runs, found)
            runs = set(again) if value[0] else last | set(again) if "" not in last else {""}  # a letter comes before what follows
            runs = runs if len(runs) <= MOST_WORDS else {""}
        else:
            _ended(runs, found)
            runs = {""}
            if op in _REPEATS and value[0] > 0:
                found += _needed(value[2], edges)
            elif op is parser.ASSERT:
                found += _needed(value[1], edges)
            elif op is parser.BRANCH:
                parts = [max(_needed(branch, edges), key=lambda words: min(map(len, words)), default=set()) for branch in value[1]]
                if all(parts):
                    found.append(set().union(*parts))
    return runs


#: Places, kinds of letters and repeats as Python's and Java's engines both read them; Java's kinds are those of ASCII, so that only ASCII texts are given to it.
_PLACES = {parser.AT_BEGINNING: r"\A", parser.AT_BEGINNING_STRING: r"\A", parser.AT_BOUNDARY: r"\b", parser.AT_END: r"(?![^\n]|\n[\s\S])", parser.AT_END_STRING: r"(?![\s\S])"}
_KINDS = {parser.CATEGORY_DIGIT: r"\d", parser.CATEGORY_NOT_DIGIT: r"\D", parser.CATEGORY_WORD: r"\w", parser.CATEGORY_NOT_WORD: r"\W", parser.CATEGORY_SPACE: r"\s\x1c-\x1f"}
_MOST_REPEATS = 1000
_PLAIN = [chr(c) if chr(c).isalnum() or chr(c) in " _" else f"\\x{c:02x}" for c in range(128)]


def shared(pattern: str) -> str | None:
    """``pattern`` in words that both engines read alike, letters in either case; None where there are none for it."""
    return _all_shared(parser.parse(pattern, re.IGNORECASE))


def _all_shared(tree) -> str | None:
    with suppress(KeyError, IndexError):  # what is in none of the tables
        return _shared(tree) if tree.state.flags == re.IGNORECASE | re.UNICODE else None


def _plain(code: int) -> str:
    return chr(code) if code in _CODES else _PLAIN[code]


@lru_cache(maxsize=4096)
def _kind(value: tuple) -> str:
    out = ""
    for op, v in value:
        out += "^" if op is parser.NEGATE else _plain(v) if op is parser.LITERAL else f"{_PLAIN[v[0]]}-{_PLAIN[v[1]]}" if op is parser.RANGE else _KINDS[v]
    return f"[{out}]"


def _shared(items) -> str:
    out = []
    for op, value in items:
        if op is parser.LITERAL:
            out.append(_plain(value))
        elif op is parser.NOT_LITERAL:
            out.append(f"[^{_plain(value)}]")
        elif op is parser.IN:
            out.append(_kind(tuple(value)))
        elif op is parser.ANY:
            out.append(r"[^\n]")
        elif op is parser.AT:
            out.append(_PLACES[value])
        elif op is parser.SUBPATTERN and not value[1] and not value[2]:
            out.append(f"(?:{_shared(value[3])})")
        elif op is parser.BRANCH:
            out.append(f"(?:{'|'.join(map(_shared, value[1]))})")
        elif op in (parser.ASSERT, parser.ASSERT_NOT) and value[0] > 0:
            out.append(f"(?{'=' if op is parser.ASSERT else '!'}{_shared(value[1])})")
        elif op in _REPEATS and len(value[2]) == 1 and value[2][0][0] in (parser.LITERAL, parser.NOT_LITERAL, parser.IN, parser.ANY):  # of single letters: engines differ on repeats of what may be empty
            low, high = value[0], "" if value[1] is parser.MAXREPEAT else value[1]
            if max(low, high or 0) > _MOST_REPEATS:
                raise KeyError(op)
            times = {(0, ""): "*", (1, ""): "+", (0, 1): "?"}.get((low, high), f"{{{low},{high}}}")
            out.append(f"{_shared(value[2])}{times}{'?' if op is parser.MIN_REPEAT else ''}")
        else:
            raise KeyError(op)
    return "".join(out)


def compiled(pattern: str) -> re.Pattern | None:
    """None if it does not compile."""
    with suppress(re.error, OverflowError, RecursionError):
        return re.compile(pattern, re.IGNORECASE)


# Keys: hashes of bytes, the same for a word and for its place in a longer text.


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n, base = PIECE + 2 * KEY_LETTERS, 0x9E3779B97F4A7C15
    powers = [np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    for p in powers:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return powers[0], powers[1]


def _sums(letters: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(letters)], out=sums[1:])
    return sums


def _keys(sums: np.ndarray, begin: np.ndarray, length: np.ndarray | int, edge: bool = False) -> np.ndarray:
    up, down = _powers()
    h = (sums[begin + length] - sums[begin]) * down[begin]
    if edge:
        h += np.uint64(ord(EDGE) + 1) * up[length : length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _cut(word: str) -> str:
    return word if len(word) <= KEY_LETTERS else word[:KEY_LETTERS]  # cut before its EDGE, too


def _word_letters(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The letters of words cut to KEY_LETTERS, where each begins and its length, for as many words at a time as fit a piece."""
    step = PIECE // (KEY_LETTERS + 1)
    for k in range(0, len(words), step):
        lengths = np.fromiter(map(len, words[k : k + step]), np.int64, len(words[k : k + step]))
        yield np.frombuffer("".join(words[k : k + step]).encode("ascii"), np.uint8), np.cumsum(lengths) - lengths, lengths


def word_keys(words: list[str]) -> np.ndarray:
    """Keys of ``words`` cut to KEY_LETTERS."""
    return np.concatenate([np.zeros(0, np.uint64), *(_keys(_sums(letters), begin, length) for letters, begin, length in _word_letters(words))])


def word_stems(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word a number for its first three letters, below 0 if it has two, and a bit for its length and whether EDGE is behind it."""
    stems, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for letters, begin, length in _word_letters(words):
        edge = letters[begin + length - 1] == ord(EDGE)
        three = [letters[np.minimum(begin + k, len(letters) - 1)].astype(np.int64) for k in range(3)]
        stems.append(np.where(length - edge > 2, three[0] << 14 | three[1] << 7 | three[2], -1 - (three[0] << 7 | three[1])))
        bits.append(np.int64(1) << length - edge + 32 * edge)
    return np.concatenate(stems), np.concatenate(bits)


def _read_rule(pattern: str) -> str:
    """``shared``, empty if None, and the sets that are ``needed``, of words in ASCII, cut, between separators that no word holds."""
    tree = parser.parse(pattern, re.IGNORECASE)
    sets = [_UNIT.join(sorted(set(map(_cut, some)))) for some in _all_needed(tree) if not any(mark in word for word in some for mark in (_UNIT, _SET, _GROUP))]
    return (_all_shared(tree) or "") + _GROUP + _SET.join(sets)


@lru_cache(maxsize=10_000)
def _read_shape(shape: str) -> tuple[str, Callable[[str], tuple[str, ...] | str]] | None:
    """What is read of a pattern, with holes, and which of its digits fill them; None if that can't be told for all digits."""
    with suppress(re.error, OverflowError, RecursionError):
        read, text, holes = _read_rule(shape), [], []
        for letter in read:
            k = ord(letter) - _CODES[0]
            if ord(letter) not in _CODES:
                text.append("%%" if letter == "%" else letter)
            elif text and text[-1] == "%s" and holes[-1].stop == k:  # the next digit
                holes[-1] = slice(holes[-1].start, k + 1)
            else:
                holes.append(slice(k, k + 1))
                text.append("%s")
        return None if read.startswith(_GROUP) or not holes else ("".join(text), itemgetter(*holes))
    return None


def read_rule(pattern: str) -> str:
    """As ``_read_rule``. Patterns that differ in digits alone are read once, with letters that stand for the digits, if both engines read them alike; digits that are no letters of their own (counts, ranges, names) let that fail."""
    if not _NOT_DIGITS.search(pattern):
        runs = _DIGITS.findall(pattern)
        digits = "".join(runs)
        if len(digits) <= len(_STANDING):
            ends = accumulate(map(len, runs))
            read = _read_shape(_DIGITS.sub(lambda m: _STANDING[(end := next(ends)) - len(m[0]) : end], pattern))
            if read is not None:
                return read[0] % read[1](digits)
    return _read_rule(pattern)


def parted(read: str) -> tuple[str | None, list[list[str]]]:
    """``shared`` and ``needed`` out of what ``read_rule`` tells."""
    plain, sets = read.split(_GROUP)
    return plain or None, [some.split(_UNIT) for some in sets.split(_SET)] if sets else []


def _counted(keys: np.ndarray) -> np.ndarray:
    """Two places among the counts for each key: a word is shared as often as the less of both says, or less often."""
    low, bits = np.uint64((1 << COUNT_BITS) - 1), np.uint64(COUNT_BITS)
    return np.stack([keys >> np.uint64(64 - COUNT_BITS), (keys & low) | (np.uint64(1) << bits)], axis=1).astype(np.int32)


def _read_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_place, pattern (as both engines read it, where ``both``), category_id, all that is read of it and which counts their words add to; rules that do not compile go."""
    for batch in batches:
        place, category, kept, patterns, both, sets, words, ends = batch.column("_place"), batch.column("category_id"), [], [], [], [], [], [0]
        for k, pattern in enumerate(batch.column("pattern").to_pylist()):
            with suppress(re.error, OverflowError, RecursionError):
                own = read_rule(pattern)
                plain, some_words = parted(own)
                kept.append(k)
                patterns.append(plain if plain is not None else pattern)
                both.append(plain is not None)
                sets.append(own)
                words += {word for some in some_words for word in some if word.isascii()}
                ends.append(2 * len(words))
        counted = _counted(word_keys(words)).ravel()
        take = pa.array(kept, pa.int32())
        columns = [place.take(take), pa.array(patterns, pa.string()), pa.array(both, pa.bool_()), category.take(take), pa.array(sets, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counted))]
        yield pa.RecordBatch.from_arrays(columns, names=["_place", "pattern", "both", "category_id", "read", "counted"])


def rule_words(rules: DataFrame) -> DataFrame:
    """_key, _stem, _lengths, _place, pattern, both, category_id: a row for each word that stands for a rule of ``rules`` (pattern, category_id, _place), stored; one without a key for a rule that has no word, or only such as too many share."""
    spark = rules.sparkSession
    read = stored(rules.select("pattern", "category_id", "_place").mapInArrow(_read_rules, "_place long, pattern string, both boolean, category_id string, read string, counted array<int>"), "rules-read")
    rows = read.select(F.explode("counted").alias("at")).groupBy("at").agg(F.count("*").alias("n")).toArrow()  # at most 2 ** COUNT_BITS, twice
    counts = np.zeros(2 << COUNT_BITS, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    most = MOST_SHARING + 8 * int(counts.sum()) // len(counts)
    known = spark.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, words, loose = [], [], []
            every = [[some for some in parted(r)[1] if r.isascii() or all(map(str.isascii, some))] for r in batch.column("read").to_pylist()]
            n = known.value[_counted(word_keys([w for sets in every for some in sets for w in some]))].min(axis=1).tolist()
            at = 0
            for k, sets in enumerate(every):
                best, chosen = (most, 0), []
                for some in sets:
                    rank = (max(n[at : at + len(some)]), -min(map(len, some)))
                    at += len(some)
                    if rank <= best:
                        best, chosen = rank, some
                chosen = list(dict.fromkeys(chosen))
                words += chosen
                rule += [k] * len(chosen)
                loose += [] if chosen else [k]
            take, none = pa.array(rule + loose, pa.int32()), np.arange(len(rule) + len(loose)) >= len(rule)
            values = [np.concatenate([v, np.zeros(len(loose), np.int64)]) for v in (word_keys(words).view(np.int64), *word_stems(words))]
            columns = [*(pa.array(v, mask=none) for v in values), *(batch.column(c).take(take) for c in ("_place", "pattern", "both", "category_id"))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_stem", "_lengths", "_place", "pattern", "both", "category_id"])

    return stored(read.drop("counted").mapInArrow(choose, "_key long, _stem long, _lengths long, _place long, pattern string, both boolean, category_id string"), "rule-words")


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([c < 128 and chr(c).isalnum() or c == 95 for c in range(256)])


def _letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``texts`` in lower case, one text after another, and where each begins and the last ends."""
    _, ends, letters = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(letters, np.uint8)[ends[0] : ends[-1]] if letters and letters.size else np.zeros(0, np.uint8)
    if (letters > 127).any():
        low = [t.translate(ALIKE).lower().encode() for t in texts.to_pylist()]
        letters, ends = np.frombuffer(b"".join(low), np.uint8), np.cumsum([0, *map(len, low)])
    return _LOWER[letters], ends - ends[0]


def _found(letters: np.ndarray, ends: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key), each once, of the words in ``letters``."""
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(letters), PIECE):
        own = letters[begin : begin + PIECE + KEY_LETTERS + 1]
        three = np.zeros(len(own) + 2, np.int32)
        three[: len(own)] = np.minimum(own, 127)
        stems = (three[:-2] << 14 | three[1:-1] << 7 | three[2:])[:PIECE]
        asked = lengths[stems]
        at = np.nonzero(asked)[0]
        if not len(at):
            continue
        asked, text, sums = asked[at], np.searchsorted(ends, begin + at, "right") - 1, _sums(own)
        room, any_length = ends[text + 1] - begin - at, int(np.bitwise_or.reduce(asked))
        for bit in range(any_length.bit_length()):
            length, edge = bit % 32, bit >= 32
            if any_length >> bit & 1:
                some = np.nonzero((asked >> np.uint64(bit) & np.uint64(1)).astype(bool) & (room >= length))[0]
                if edge:
                    some = some[(room[some] == length) | ~_IN_WORD[own[np.minimum(at[some] + length, len(own) - 1)]]]
                key = _keys(sums, at[some], length, edge)
                place = key >> np.uint64(64 - FILTER_BITS)
                held = (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                texts.append(text[some[held]])
                keys.append(key[held])
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    once = np.ones(len(text), bool)
    once[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[once], key[once]


def text_keys(texts: DataFrame, words: DataFrame) -> DataFrame:
    """_text, _key: for each of ``texts`` (_text, not null) the keys of ``words`` (see ``rule_words``) that it holds, and a few that only look so."""
    words = words.where("_key is not null")
    lengths = np.zeros(1 << 21, np.uint64)  # of the words that begin with three letters
    stems = words.groupBy("_stem").agg(F.bit_or("_lengths").alias("bits")).toArrow()  # 7 bits a letter: two millions at most
    for stem, bits in zip(stems["_stem"].to_pylist(), stems["bits"].to_pylist(), strict=True):
        lengths[stem if stem >= 0 else slice((-1 - stem) << 7, -stem << 7)] |= np.uint64(bits)
    known = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    at, bit = f"CAST(shiftrightunsigned(_key, {70 - FILTER_BITS}) AS int)", f"shiftleft(1L, CAST(shiftrightunsigned(_key, {64 - FILTER_BITS}) & 63 AS int))"
    rows = words.groupBy(F.expr(at).alias("at")).agg(F.bit_or(F.expr(bit)).alias("bits")).toArrow()  # at most 2 ** (FILTER_BITS - 6)
    known[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    shared_tables = texts.sparkSession.sparkContext.broadcast((lengths, known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            text, key = _found(*_letters_of(batch.column("_text").cast(pa.large_string())), *shared_tables.value)
            yield pa.RecordBatch.from_arrays([batch.column("_text").take(pa.array(text)), pa.array(key.view(np.int64))], names=["_text", "_key"])

    return texts.select("_text").mapInArrow(find, "_text string, _key long")


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose pattern is null or matches their text."""
    known: dict[str, re.Pattern | None] = {}
    for batch in batches:
        patterns, rows = batch.column("pattern"), batch.select(["_text", "_place", "category_id"])
        if patterns.null_count == len(patterns):
            yield rows
            continue
        kept = []
        for text, pattern in zip(rows.column("_text").to_pylist(), patterns.to_pylist(), strict=True):
            if pattern is not None and pattern not in known:
                if len(known) >= MOST_COMPILED:
                    known.clear()
                known[pattern] = compiled(pattern)
            kept.append(pattern is None or known[pattern] is not None and known[pattern].search(text) is not None)
        yield rows.filter(pa.array(kept, pa.bool_()))


def first_by_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """_text, _place, matched: the first rule that each of ``texts`` (_text) matches, and its category, of those that have ``words`` (see ``rule_words``); texts that match none go."""
    met = text_keys(texts, words).join(words.select("_key", "_place", "pattern", "both", "category_id"), "_key")
    either = F.col("both") & (F.octet_length("_text") == F.length("_text"))  # both engines tell the same
    left = met.where(F.when(either, F.expr("_text rlike concat('(?i)', pattern)")).otherwise(True)).select("_text", "_place", "category_id", F.when(~either, F.col("pattern")).alias("pattern"))
    matched = left.mapInArrow(_tried, "_text string, _place long, category_id string")
    return matched.groupBy("_text").agg(F.min(F.struct("_place", "category_id")).alias("_first")).select("_text", "_first._place", F.col("_first.category_id").alias("matched"))
