"""Large buckets of near copies: their sets meet once, not once for each bucket, and buckets that share few sets stay apart."""

import random
from fractions import Fraction

import pytest

from quillpath.llm import minhash, ngram_join
from tests.llm.test_pairs_and_leaks import components, words_of


def near_copies(n, seed):
    r = random.Random(seed)
    base = words_of(60, seed)
    return [" ".join(w if r.random() > 0.015 else "".join(r.sample("ijklmnop", 5)) for w in base) for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 50])
@pytest.mark.parametrize("found", [minhash.near_duplicates, ngram_join.similar])
def test_sets_of_a_crowd_meet_once(spark, monkeypatch, found, block):
    seen, many_pairs = [], ngram_join._many_pairs

    def counting(rows, *more):
        seen.append((rows.count(), rows.select("sid").distinct().count()))
        return many_pairs(rows, *more)

    monkeypatch.setattr(ngram_join, "_many_pairs", counting)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = list(enumerate(near_copies(220, 1)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found(spark.createDataFrame(docs, "doc_id long, text string"), 4, Fraction(4, 5)).collect()}
    assert got == components(docs, 4, Fraction(4, 5))
    assert seen and all(rows <= 3 * sets for rows, sets in seen)


def test_crowds(spark):
    r = random.Random(2)
    # 20 buckets of half of the sets 0 to 199 each; two buckets that share one set
    buckets = {k: r.sample(range(200), 100) for k in range(20)} | {100: range(1000, 1100), 101: range(1099, 1199)}
    rows = [(k, s, 50, s % 2 == k % 2, len(b), s // 3) for k, b in buckets.items() for s in b]
    df = spark.createDataFrame(rows, "key long, sid long, size int, own boolean, rows long, label long")
    got = ngram_join._crowds(df).collect()
    met = {}
    for x in got:
        assert x.size == 50 and x.label == x.sid // 3 and x.sid not in met.setdefault(x.key, {})
        met[x.key][x.sid] = x.own
    assert all(any(set(b) <= set(m) for m in met.values()) for b in buckets.values())
    assert all(m[s] >= own for k, s, _, own, _, _ in rows for m in met.values() if set(buckets[k]) <= set(m))
    assert sorted(map(len, met.values())) == [100, 100, 200]
