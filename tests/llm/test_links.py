"""All links of the n-gram join, inside components too, against brute force."""

from fractions import Fraction

import pytest

from quillpath.llm import ngram_join
from tests.llm.test_pairs_and_leaks import corpus, shingles

T = Fraction(4, 5)


@pytest.mark.parametrize("few", [48, 2])
def test_all_links(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 7 if few == 2 else 2048)
    docs = corpus()
    docs += [(10_000 + i, x) for i, (_, x) in enumerate(docs[:20])]
    sets = [(d, frozenset(shingles(x, 5))) for d, x in docs]
    near = lambda a, b: bool(a & b) and len(a & b) * T.denominator >= len(a | b) * T.numerator
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    if few == 48:
        want = {d: sum(near(s, o) for e, o in sets if e != d) for d, s in sets}
        assert max(want.values()) > 2
        assert {r.doc_id: r.n_links for r in ngram_join.link_counts(df, 5, T).collect()} == want
    else:
        first, copies = {}, {}
        for d, s in sets:
            first[s], copies[s] = min(d, first.get(s, d)), copies.get(s, 0) + 1
        each = [s for s in first if s]
        want = sorted((min(first[a], first[b]), max(first[a], first[b])) for i, a in enumerate(each) for b in each[i + 1 :] if near(a, b))
        got = ngram_join.links(df, 5, T).collect()
        assert sorted((r.a, r.b) for r in got) == want
        by = {first[s]: copies[s] for s in each}
        assert all((r.a_copies, r.b_copies) == (by[r.a], by[r.b]) for r in got)
