"""Similar documents and vectors against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import jaccard, neighbours, vectorgraph
from tests.llm.helpers import documents, near, texts, vectors, words


def shingles(text, width=5):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(ids, linked):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    real = [(i, s) for i, s in sets if i is not None and s]
    linked = [(a, b) for k, (a, s) in enumerate(real) for b, u in real[:k] if 100 * len(s & u) >= 80 * len(s | u)]
    comp = components({i for i, _ in sets if i is not None}, linked)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("rows", [texts(), [(k, near(words(120, 5), k % 9, k)) for k in range(60)], [(k, words(10, k // 3)) for k in range(30)], []])
def test_similar_documents(spark, rows):
    found = jaccard.similar_documents(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == expected(rows)


def test_similar_without_broadcast_and_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "WALK", 3)
    monkeypatch.setattr(jaccard, "MAIN_BLOCK", 5)
    rows = [(k, near(words(150, 9), 3 * (k % 5), k)) for k in range(50)]
    found = jaccard.similar_documents(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("hot_level", [0, 1])
def test_similar_with_frequent_passages_and_a_large_component(spark, monkeypatch, hot_level):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "MAIN_BLOCK", 7)
    monkeypatch.setattr(jaccard, "HOT_LEVEL", hot_level)
    base, one, two = words(200, 1), words(70, 2), words(60, 3)
    rows = [(k, near(base, k % 3, k)) for k in range(40)]  # one component
    rows += [(100 + k, near(base, 12 + k, k)) for k in range(25)]  # near misses of it
    rows += [(200 + k, f"{one} {words(14, 300 + k)} {two}") for k in range(30)]  # passages that many share, linked through them or not
    rows += [(300 + k, f"{words(40, 400 + k)} {one}") for k in range(30)] + [(7, near(base, 60, 5)), (8, f"{one} {two}")]
    found = jaccard.similar_documents(documents(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == expected(rows)


def test_a_document_with_two_texts_joins_what_each_links_to(spark):
    a, b = words(50, 1), words(50, 2)
    rows = [(3, a), (5, b), (7, a), (7, b), (9, near(b, 1, 1)), (11, words(50, 3))]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(documents(spark, rows)).collect())
    assert got == [(3, 3), (5, 3), (7, 3), (7, 3), (9, 3), (11, 11)] == sorted((i, c) for i, _, c in expected(rows))


def test_groups_within_an_earlier_one_are_left_out(spark):
    met = [(h, i) for h, ids in ((1, [1, 2, 3, 4]), (2, [1, 2, 3]), (3, [1, 2]), (5, [3, 4]), (6, [4, 5]), (7, [4, 5]), (8, [1, 5])) for i in ids]
    left = {r["h"] for r in jaccard._open_groups(spark.createDataFrame(met, "h long, id long"), spark.createDataFrame([], "id long, component long")).collect()}
    meets = lambda hs: {(a, b) for h, a in met if h in hs for g, b in met if g == h and a < b}
    assert left == {1, 6, 8} and meets(left) == meets(range(9))


def test_sketches_never_rule_out_similar_sets():
    r = np.random.default_rng(2)
    for n in (3, 50, 1023, 1024, 1025, 3000):
        a = r.integers(0, 1 << 60, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 10], r.integers(0, 1 << 60, n // 10).astype(np.uint64)])
        x, y = jaccard.parity(a), jaccard.parity(b)
        z = min(len(x), len(y))
        assert np.bitwise_count(np.bitwise_xor(*jaccard.folded([x, y], z))).sum() <= len(np.setxor1d(a, b))


def test_walk_finds_what_pairs_find():
    r = np.random.default_rng(4)
    sets = [np.unique(r.choice(60, size=r.integers(1, 30), replace=False).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[1:], s[:1] + np.uint64(60)])) for s in sets[:40]]
    for probe in sets[:30]:
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))}
        assert set(jaccard.walk(probe, sets, 80)) == want


def usable(rows):
    return [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "v": F.lit("x"), "cluster": F.lit(2)})


def test_search(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in vectors()]
    real = usable(rows)
    got = neighbours.search(frame(spark, rows), lambda i: i % 10 == 0, k=10).collect()
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    hits = total = 0
    for i, v in real:
        if i % 10:
            continue
        best = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in real if j != i)[:10]
        mine = [found[i, r] for r in range(1, 11)]
        assert [(s, j) for j, s in mine] == sorted((s, j) for j, s in mine)
        dist = {j: float(np.sqrt(((v - w) ** 2).sum())) for j, w in real}
        assert all(abs(dist[j] - s) < 1e-9 for j, s in mine)
        hits += len({j for j, _ in mine} & {j for _, j in best})
        total += 10
    assert hits / total >= 0.9 and {q for q, _ in found} == {i for i, _ in real if i % 10 == 0}


def test_search_small_and_empty(spark):
    few = [(100, [1.0] * 16, 0), (101, [2.0] * 16, 0), (102, None, 0)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(frame(spark, few), lambda i: i % 100 == 0).collect()] == [(100, 1, 101)]
    assert neighbours.search(frame(spark, []), lambda i: i % 100 == 0).count() == 0


def test_vector_components(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in vectors(400)]
    real = usable(rows)
    unit = np.array([v / np.linalg.norm(v) for _, v in real])
    near_ = unit @ unit.T >= 0.9
    np.fill_diagonal(near_, False)
    ids = [i for i, _ in real]
    comp = components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near_)])
    got = vectorgraph.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    links = {r["vec_id"]: r["n_links"] for r in got}
    want = dict(zip(ids, near_.sum(axis=1).tolist(), strict=True))
    assert near_.sum() > 200 and sum(min(links[i], want[i]) for i in ids) >= 0.97 * sum(want.values()) and all(links[i] <= want[i] for i in ids)
    assert sum(r["component_id"] == comp[r["vec_id"]] for r in got if r["vec_id"] in comp) >= 0.97 * len(ids)
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] not in comp)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in got)
    assert vectorgraph.near_duplicates(frame(spark, [])).count() == 0


def test_words_that_polynomials_take_for_the_same(spark):
    """The Thue-Morse word over a and b and the same with a and b swapped: any polynomial modulo 2^64 agrees on the two."""
    from tallyhouse.llm import shingles

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    sets = shingles.shingle_sets([word, other, word.upper(), f"x {word} y", "c" * 300_000, "c" * 299_999 + "d", "c" * 300_000], 5)
    assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist() and sets[4].tolist() == sets[6].tolist() != sets[5].tolist()
    texts = [" ".join([w] * 3 + [str(k) for k in range(4)]) for w in (word, other, word)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, percent=80).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
