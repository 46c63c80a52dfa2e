"""Ids of a lower-casing word-end BPE vocabulary, by the tokenizers library, with each pre-token encoded once.

The vocabulary drops white space and never merges across pre-tokens, so a text's ids are those of its
pre-tokens in turn. Texts of plain Latin letters are cut into pre-tokens here; any other text is cut at
spaces and line ends only, and the library does the rest of the work on each word.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: The vocabulary's pre-token pattern, for Latin-1 text that is lower-cased already.
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_PRETOKENS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+".encode("latin-1"))
#: Characters of the texts that are cut here, as bytes of Latin-1, and what each becomes in lower case.
_USUAL = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
_LOWER = bytes(ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in map(chr, range(256)))
_SPACES = re.compile(r"[ \n]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Encoder with a memo of pre-tokens and one of words that only the library can cut; either is emptied when it passes ``limit`` entries."""

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = limit
        self.size = self.library.get_vocab_size()
        self.dtype, kind = (np.uint16, "H") if self.size <= 65536 else (np.uint32, "I")
        library, tokenize, letters = self.library, self.library.model.tokenize, byte_letters()

        class PreTokens(dict):
            def __missing__(self, token: bytes) -> bytes:
                seen = token.decode() if token.isascii() else token.decode("latin-1").encode().decode("latin-1").translate(letters)
                ids = self[token] = array(kind, [t.id for t in tokenize(seen)]).tobytes()
                return ids

        class OddWords(dict):
            def __missing__(self, word: str) -> bytes:
                ids = self[word] = array(kind, library.encode(word, add_special_tokens=False).ids).tobytes()
                return ids

        self.memos = PreTokens(), OddWords()

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned integers of ``dtype``; no ids for null."""
        if not text:
            return b""
        for memo in self.memos:
            if len(memo) > self.limit:
                memo.clear()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or b"<|" in raw or raw.translate(None, _USUAL):
            return b"".join(map(self.memos[1].__getitem__, _SPACES.split(text)))
        return b"".join(map(self.memos[0].__getitem__, _PRETOKENS.findall(raw.translate(_LOWER))))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The worker's encoder for this vocabulary file."""
    return WordIds(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """True at each id that ends a sentence: punctuation with a full stop, question or exclamation mark."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        if re.fullmatch(r"[^\w]*[.!?][^\w]*</w>", token):
            ends[i] = True
    return ends
