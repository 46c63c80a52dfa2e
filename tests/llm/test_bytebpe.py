"""Byte-level BPE against the tokenizers library, id by id, and texts in pieces."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhouse.llm import bytebpe
from tallyhouse.llm.queries import vocabulary
from tests.llm.helpers import documents, texts, words

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), bytebpe.ByteBpe(PATH)
END = "<|endoftext|>"
ODD = ["", " ", "  ", "\n", "a  b ", "Don't we'll IT'S 'sx x's", "naïve Straße ÀÉ µm ß", "日本語 text 😀👩‍👩‍👧", "x\u0000y\x1c\x1dz", END, f"a{END}{END} b  {END}", "<|endof", "12.5%  ...!?\n\n\tend", "é́é", " end ", "ᱜ₏ẞ", "　  a"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def in_pieces(text, block):
    cuts = list(OWN.cuts(text, block))
    assert "".join(text[b:e] for b, e, _ in cuts) == text
    return OWN.joined([(opened, OWN.piece(text[b:e])) for b, e, opened in cuts]).ids.tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert OWN.encode(text).tolist() == ids_of(text)
    assert OWN.decode(ids_of(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'’.abst19")), max_size=60), st.integers(3, 20))
def test_any_text(text, block):
    assert OWN.encode(text).tolist() == ids_of(text) == in_pieces(text, block)


@pytest.mark.parametrize("alphabet", ["a", "ab", " ", " \n", "=-", "0", "0123456789", "abcdefghijklmnopqrstuvwxyz", "aA", "'s", "!'", "é", "日本語", "ab1.'s " + "  "])
def test_long_unsplit_text(alphabet):
    r = random.Random(1)
    text = "".join(r.choice(alphabet) for _ in range(20_000))
    assert OWN.encode(text).tolist() == ids_of(text) == in_pieces(text, 700)


def test_a_join_grows_until_both_sides_agree():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abcde") for _ in range(r.randrange(2, 200)))
        at = r.randrange(1, len(text))
        left, right = (np.array(ids_of(t)) for t in (text[:at], text[at:]))
        joined = OWN.join(*(bytebpe.array("I", x.tolist()) for x in (left, right)))
        assert joined.tolist() == ids_of(text)


def test_any_ids_decode():
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50_257) for _ in range(r.randrange(30))]
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    """Nulls, repeated rows, long and unsplit texts, clashing columns; a block so small that most texts are cut."""
    rows = texts() + [(900 + k, t) for k, t in enumerate(ODD)] + [(990, "ab" * 9000), (990, "ab" * 9000), (991, words(4000, 5)), (None, words(900, 6)), (None, words(900, 6))]
    ids = [ids_of(t or "") for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(rows, ids, strict=True)), key=str)
    for block in (bytebpe.BLOCK, 300):
        got = bytebpe.encode(documents(spark, rows), PATH, ids=False, digests=True, block=block).collect()
        assert sorted(map(tuple, got), key=str) == want
    plain = bytebpe.encode(documents(spark, rows), PATH, block=300).collect()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in plain), key=str) == sorted(((i, x, t or "") for (i, t), x in zip(rows, ids, strict=True)), key=str)
    assert bytebpe.encode(documents(spark, []), PATH).count() == 0
