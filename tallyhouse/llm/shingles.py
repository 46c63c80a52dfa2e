"""Word shingles as 60-bit hashes, whole batches of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

#: Fixed values of the contract: words are runs of other bytes than these; A-Z count as a-z.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes hashed at a time.
BLOCK = 1 << 18
#: Bytes up to which a word's hash is a polynomial; that of a longer one is a digest, since there are unlike words of 1024 letters and more that every polynomial modulo 2^64 takes for the same.
LONG = 128
HASH_BITS = 60
MASK = np.uint64((1 << HASH_BITS) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTOR = 0x9E3779B97F4A7C17
_SEPARATES = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SEPARATORS, np.uint8))
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUE = _mixed((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _powers(factor: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, np.uint64(factor & (1 << 64) - 1), np.uint64)]), dtype=np.uint64)


_POWER, _INVERSE = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin (byte) and 64-bit hash of each word of a text in UTF-8. Works in blocks that end between words."""
    begins, hashes, at = [], [], 0
    while at < len(buf):
        part = buf[at : at + BLOCK]
        gaps = _SEPARATES[part]
        if at + BLOCK < len(buf) and not gaps[-1]:
            ends = np.flatnonzero(gaps)
            if not len(ends):  # one word longer than a block
                rest = np.flatnonzero(_SEPARATES[buf[at:]])
                end = at + int(rest[0]) if len(rest) else len(buf)
                begins.append(np.array([at]))
                hashes.append(np.array([_digest(buf[at:end])]))
                at = end
                continue
            part, gaps = part[: ends[-1] + 1], gaps[: ends[-1] + 1]
        edge = np.diff(np.concatenate([[True], gaps, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUE[part] * _POWER[: len(part)], dtype=np.uint64)])
        begins.append(first + at)
        found = _mixed((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(np.uint64))
        for k in np.flatnonzero(last - first > LONG).tolist():
            found[k] = _digest(part[first[k] : last[k]])
        hashes.append(found)
        at += len(part)
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(begins), np.concatenate(hashes)


def _digest(word: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word.tobytes().lower(), digest_size=8).digest(), "little"))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct ``width``-word shingles, as ascending hashes. Fewer words are one shingle; no word, none."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    begins, words = word_hashes(buf)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]) if raw else np.zeros(0, np.int64)
    cut = np.searchsorted(begins, np.append(starts, len(buf) + 1))
    step = [pow(_FACTOR, 3 * j + 5, 1 << 64) for j in range(width)]
    n = len(words)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += words[j : n - width + 1 + j] * np.uint64(step[j])
        total = _mixed(total) & MASK
    sets = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo >= width:
            sets.append(np.unique(total[lo : hi - width + 1]))
        elif hi > lo:
            h = np.array([hi - lo], np.uint64)
            for j in range(hi - lo):
                h = h + words[lo + j : lo + j + 1] * np.uint64(step[j])
            sets.append(_mixed(h) & MASK)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
