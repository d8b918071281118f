"""MinHash near-duplicates against brute force, with edge cases."""

import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from quillpath.llm import minhash, ngram_join
from tests.llm.test_pairs_and_leaks import components, corpus, shingles, words_of

T = Fraction(4, 5)


def got(df, width=4, threshold=T):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, threshold).collect()}


@pytest.mark.parametrize("few", [48, 2])
def test_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 7 if few == 2 else 2048)
    docs = corpus()
    docs += [(10_000 + i, x) for i, (_, x) in enumerate(docs[:20])]
    want = components(docs, 4, T)
    assert any(c != d for d, (_, c) in want.items())
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == want


def test_match_threshold():
    m = minhash.least_matches(T)
    at = lambda k: comb(80, k) * 0.8**k * 0.2 ** (80 - k)
    assert sum(map(at, range(m))) <= minhash.MISS < sum(map(at, range(m + 1)))
    assert 2 * m > 70  # a prefix is no longer than about half a signature


def test_collisions_follow_similarity():
    r = random.Random(5)
    words = words_of(4000, 1)
    a = set(r.sample(range(4000), 2000))
    b = set(r.sample(sorted(a), 1800)) | set(r.sample(sorted(set(range(4000)) - a), 200))
    import numpy as np

    names = np.array([hash((w, i)) & (2**64 - 1) for i, w in enumerate(words)], np.uint64)
    names = minhash.mixed(names)
    x, y = (minhash.signature(np.sort(names[sorted(s)]), np.array([0, len(s)])) for s in (a, b))
    assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.17


def test_edges(spark):
    base = words_of(100, 3)
    variants = [" ".join([*base[:-1], w]) for w in ("one", "two", "three")]
    rows = [(None, variants[0]), (None, variants[1]), (7, variants[2]), (8, None), (9, ""), (10, " \n\t"), (11, "Same Words"), (12, "same  words"), (12, "same words"), (13, "w" * 300_000), (14, "w" * 299_999), (None, "alone in the world we are")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, component_id int, kept boolean")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.component_size, r.kept) for r in minhash.near_duplicates(df, 4, T).collect()), key=str)
    assert found == sorted(
        [(None, 97, 7, 3, False)] * 2
        + [(7, 97, 7, 3, True), (8, 0, 8, 1, True), (9, 0, 9, 1, True), (10, 0, 10, 1, True), (11, 1, 11, 3, True), (12, 1, 11, 3, False), (12, 1, 11, 3, False), (13, 1, 13, 1, True), (14, 1, 14, 1, True), (None, 3, None, 1, True)],
        key=str,
    )
    assert minhash.near_duplicates(df.limit(0), 4, T).count() == 0
    # the n-gram join has the same links
    same = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df, 4, T).collect()}
    assert same == {f[:3] for f in found}


def test_a_shared_passage_links_nothing(spark):
    common = words_of(80, 1)
    docs = [(i, " ".join(words_of(60, 100 + i) + common)) for i in range(150)]
    docs += [(1000 + i, t.replace(" ", "  ", 3) + " end") for i, t in docs[:30]]
    found = got(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found == {d: (len(shingles(t, 4)), d % 1000 if d >= 1000 else d) for d, t in docs}


def test_pairs_of_a_large_bucket_grow_with_its_sets():
    from quillpath.llm.ngram_join import _forests

    rng = np.random.default_rng(3)
    for codes, forests in ((np.arange(200), 1), (rng.integers(0, 5, 200), 1), (rng.integers(0, 40, 200), 3)):
        y = np.arange(200)
        met = [(x, y[(codes != codes[x]) & (y < 100) & ((y + x) % 3 == 0)]) for x in range(100, 200)]
        u, v, more = _forests(codes, iter(met), forests)
        every = {(x, int(j)) for x, js in met for j in js}
        assert set(zip(u.tolist(), v.tolist(), strict=True)) <= every and len(u) <= forests * len(set(codes.tolist())) and more

        def parts(pairs):
            low = {c: c for c in codes.tolist()}
            for _ in low:
                for a, b in pairs:
                    a, b = int(codes[a]), int(codes[b])
                    low[a] = low[b] = min(low[a], low[b])
            return low

        assert parts(every) == parts(list(zip(u.tolist(), v.tolist(), strict=True)))
        u, v, more = _forests(codes, iter(met), 10_000)
        assert set(zip(u.tolist(), v.tolist(), strict=True)) == every and len(u) == len(every) and not more
