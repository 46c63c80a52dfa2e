"""Encoding, the chunk store and packing against the libraries, id by id."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhouse.llm import chunkstore, packing, pieces, shards
from tallyhouse.llm.queries import vocabulary
from tallyhouse.llm.storage import new_folder
from tallyhouse.llm.wordids import WordIds
from tests.llm.helpers import documents, texts, words

SP, WP = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
ODD = ["", " ", "a  b ", "▁x▁", "Don't we'll IT'S", "naïve Straße ÀÉ µm ß", "日本語 text 😀", "a b­c", "x\u0000y", "<|endoftext|> <|", "12.5%  ...!?\n\n\tend", "İstanbul ﬁ", "  line", "é"]


@pytest.fixture(scope="module")
def libraries():
    return sentencepiece.SentencePieceProcessor(model_file=SP), Tokenizer.from_file(WP)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(libraries, text):
    p = pieces.Pieces(SP)
    ids = libraries[0].encode(text)
    assert p.encode(text) == ids and p.decode(ids) == libraries[0].decode(ids)
    assert np.frombuffer(WordIds(WP).encode(text), np.uint16).tolist() == libraries[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from(" \n'’.▁")), max_size=40))
def test_any_text(text):
    p, lib, w, tok = _all()
    ids = lib.encode(text)
    assert p.encode(text) == ids
    assert p.decode(ids) == lib.decode(ids)
    assert np.frombuffer(w.encode(text), np.uint16).tolist() == tok.encode(text, add_special_tokens=False).ids


_KEPT: list = []


def _all():
    if not _KEPT:
        _KEPT.extend((pieces.Pieces(SP), sentencepiece.SentencePieceProcessor(model_file=SP), WordIds(WP), Tokenizer.from_file(WP)))
    return _KEPT


def test_encode_rows(spark, libraries):
    rows = texts() + [(900 + k, t) for k, t in enumerate(ODD)]
    got = sorted((tuple(r) for r in pieces.encode(documents(spark, rows), SP, ids=False, digests=True).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = [*libraries[0].encode(t or ""), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(libraries[0].decode(ids))))
    assert got == sorted(want, key=str)
    assert pieces.encode(documents(spark, []), SP).count() == 0


def test_store_reads_back_every_id(spark, libraries):
    rows = texts()
    path = new_folder(spark, "store")
    chunkstore.write_store(documents(spark, rows), path, WP, end_id=1, rows_per_shard=10)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in chunkstore.read_back(spark, path).collect())
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append([*libraries[1].encode(t or "", add_special_tokens=False).ids, 1])
    at, ids = 0, sorted(by_id, key=lambda i: (i is not None, i))
    for i in ids:
        mine = [g for g in got if g[1] == i]
        assert sorted((g[2], g[3]) for g in mine) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by_id[i])
        for g in mine:
            assert g[0] == at
            at += g[2]
    rebuilt = {r["doc_id"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in chunkstore.read_ids(spark, path).where("doc_id >= 20").collect()}
    assert all(rebuilt[i] == by_id[i][0] for i in by_id if i is not None and i >= 20)


PARTS = ("chunks", "recipes", "manifest", "whole")


def altered(spark, path, **changes):
    """A copy of a store in which parts are changed."""
    other = new_folder(spark, "store")
    for part in PARTS:
        rows = spark.read.parquet(f"{path}/{part}")
        changes.get(part, lambda x: x)(rows).write.partitionBy(*["shard"] * (part == "recipes")).parquet(f"{other}/{part}")
    return other


def verdicts(spark, path, **more):
    return {r["doc_id"]: r["verified"] for r in chunkstore.read_back(spark, path, **more).collect()}


def test_store_tells_damage(spark):
    path = new_folder(spark, "store")
    rows = [(1, "a b c"), (2, "d e f"), (3, "a b c")]
    chunkstore.write_store(documents(spark, rows), path, WP)
    assert spark.read.parquet(f"{path}/chunks").where("payload is not null").count() == 2
    other = altered(spark, path, chunks=lambda c: c.withColumn("payload", F.expr("if(payload is not null and doc_id = 2, cast('x1' as binary), payload)")))
    assert verdicts(spark, path) == {1: True, 2: True, 3: True}
    assert verdicts(spark, other) == {1: True, 2: False, 3: True}


def test_store_tells_altered_recipes_and_manifests(spark):
    path = new_folder(spark, "store")
    rows = [(k, words(3000 if k == 3 else 40, k)) for k in range(12)]
    root = chunkstore.write_store(documents(spark, rows), path, WP, rows_per_shard=4)
    shards = {r["doc_id"]: r["shard"] for r in spark.read.parquet(f"{path}/recipes").select("doc_id", "shard").collect()}
    assert len(set(shards.values())) == 3 and spark.read.parquet(f"{path}/recipes").where("doc_id = 3").select(F.size("chunks")).first()[0] > 3
    every = dict.fromkeys(range(12), True)
    assert verdicts(spark, path, root=root) == every
    assert not any(verdicts(spark, path, root="0" * 64).values())
    one = lambda new: lambda r: r.withColumn("chunks", F.when(F.col("doc_id") == 3, new).otherwise(F.col("chunks")))
    for new in (F.reverse("chunks"), F.slice("chunks", 1, F.size("chunks") - 1), F.concat("chunks", F.slice("chunks", 1, 1)), F.transform("chunks", lambda c: c.withField("after", c["after"] + 1))):
        got = verdicts(spark, altered(spark, path, recipes=one(new)))
        assert got == every | {3: False}
    # a recipe of another document that brings a root of its own: nothing of its shard can be trusted
    def foreign(r):
        other = r.withColumn("chunks", F.when(F.col("doc_id") == 3, F.reverse("chunks")).otherwise(F.col("chunks")))
        return chunkstore._with_root(other.withColumnRenamed("root", "old"), "root").drop("old")

    got = verdicts(spark, altered(spark, path, recipes=foreign))
    assert got == {k: shards[k] != shards[3] for k in range(12)}
    got = verdicts(spark, altered(spark, path, recipes=lambda r: r.where("doc_id <> 5")))
    assert got == {k: shards[k] != shards[5] for k in range(12) if k != 5}
    for change in (lambda m: m.withColumn("start", m["start"] + 1), lambda m: m.where("shard > 0"), lambda m: m.withColumn("n_docs", m["n_docs"] + 1)):
        assert not any(verdicts(spark, altered(spark, path, manifest=change)).values())
    assert not any(verdicts(spark, altered(spark, path, recipes=lambda r: r.where("shard > 0"))).values())


def test_tree_is_a_binary_one(spark):
    node = lambda a, b: hashlib.sha256(f"n{a}{b}".encode()).hexdigest()
    leaves = [c * 64 for c in "abcde"]
    got = spark.createDataFrame([(leaves[:n],) for n in range(1, 6)], "a array<string>").select(F.size("a"), chunkstore.merkle(F.col("a"))).collect()
    a, b, c, d, e = leaves
    assert dict(map(tuple, got)) == {1: a, 2: node(a, b), 3: node(node(a, b), c), 4: node(node(a, b), node(c, d)), 5: node(node(node(a, b), node(c, d)), e)}


def test_shards_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(shards, "MOST_BOUNDS", 4)
    rows = spark.range(0, 3000).selectExpr("id * 7 % 3000 as doc_id", "id as other").union(spark.sql("select cast(null as bigint), 1L"))
    placed, n = shards.with_shards(rows, "doc_id", 60)
    got = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("shard").collect()
    assert placed.columns == ["doc_id", "other", "shard"] and max(r["n"] for r in got) <= 90 and n >= 50 > 4 and max(r["shard"] for r in got) < n
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:], strict=False)) and sum(r["n"] for r in got) == 3001
    assert placed.where("doc_id is null").first()["shard"] == 0


def test_empty_store(spark):
    path = new_folder(spark, "store")
    chunkstore.write_store(documents(spark, []), path, WP)
    assert chunkstore.read_back(spark, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=64), st.integers(0, 5000))
def test_checksum_shift(a, n):
    shifted = chunkstore.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
    assert int(shifted) ^ zlib.crc32(b"\x07" * n) == zlib.crc32(a + b"\x07" * n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.integers(0, 1 << 30))
def test_cuts_cost_least(gaps, bits):
    places = np.cumsum([0, *gaps])
    penalty = np.array([0.0] + [float(bits >> 3 * k & 7) for k in range(len(gaps))])
    window = 10

    def cost(cuts):
        ends = [0, *cuts]
        if any(b - a > window for a, b in zip(ends, ends[1:], strict=False)):
            return None
        return sum(window - (b - a) for a, b in zip(ends, ends[1:], strict=False)) + sum(penalty[list(places).index(c)] for c in cuts)

    inner = places[1:-1].tolist()
    best = min(c for k in range(1 << len(inner)) if (c := cost([p for j, p in enumerate(inner) if k >> j & 1] + [int(places[-1])])) is not None)
    assert cost(packing.cut_windows(places, penalty, window)) == best


def test_packing(spark, libraries):
    rows = texts()
    got = packing.pack(documents(spark, rows), WP, end_id=2, window=512, rows_per_shard=15, with_ids=True).collect()
    docs = defaultdict(list)
    for i, t in rows:
        docs[i].append([*libraries[1].encode(t or "", add_special_tokens=False).ids, 2])
    sequences = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in docs.items():
        mine = sorted((r["sequence_id"], r["offset"], r["start"], r["ids"]) for r in got if r["doc_id"] == i)
        streams, at = [], 0
        for _, _, start, ids in mine:
            if start == 0:
                streams.append([])
                at = 0
            assert start == at
            streams[-1] += ids
            at += len(ids)
        assert sorted(streams) == sorted(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(documents(spark, []), WP).count() == 0
