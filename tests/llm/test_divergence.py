"""Source divergence audit against brute force, with edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillpath.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, ranks=200):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [t.translate(lower) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= 3)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(of[s][t], q[t])) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def got(spark, rows, ranks=200, columns="lang string, source string, text string"):
    found = divergence.audit(spark.createDataFrame(rows, columns).repartition(3), ranks).collect()
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found)


def corpus(seed, sources=6, docs=120, vocabulary=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    out = []
    for _ in range(docs):
        s = min(r.randrange(sources), r.randrange(sources))
        own = words[s * 20 : s * 20 + 60] + words[:40]
        out.append((r.choice(["en", "de"]), f"src{s}", "".join(r.choice(own).title() + r.choice([" ", "1", "-_", "\n"]) for _ in range(r.randint(0, 150)))))
    return out


@pytest.mark.parametrize("ranks", [200, 5])
def test_against_brute_force(spark, ranks):
    rows = corpus(ranks)
    want = brute(rows, ranks)
    assert {w[2] for w in want} == {"pair", "term"}
    assert got(spark, rows, ranks) == want


def test_small_memory_and_many_sources(spark, monkeypatch):
    """Tasks give counts away early, postings lie in several rows, and nothing is broadcast."""
    for name, value in (("HELD", 50), ("BLOCK", 3), ("PAIRS", 10), ("FEW", 1)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(9, sources=9)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(None, None, None), (None, "s", "one two one"), ("", "s", "one"), ("", "", "one two"), ("en", "a", "x"), ("en", "b", ""), ("en", "c", "123 --"), ("fr", "a", "É é " * 3), ("fr", "a", "É é"), ("fr", "b", "é É z"), ("fr", "b", "漢" * 100_000), ("fr", None, "Z" * 200_000 + " é")]
    rows += [("eq", s, "same words here") for s in "abc"]
    wide = [(*r, "clash", 1, 2) for r in rows]
    assert got(spark, wide, columns="lang string, source string, text string, term string, `count` int, gid int") == brute(rows)
    assert got(spark, rows[:0]) == []
    assert [r for r in got(spark, rows) if r[0] == "eq"] == [("eq", s, "pair", o, 0, k + 1) for s in "abc" for k, o in enumerate(x for x in "abc" if x != s)]


def test_share_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (7, 9), (10**12, 3 * 10**13), (99_999_999_999, 100_000_000_001), (123_456_789_012, 234_567_890_123_456), (0, 10**14)]
    df = spark.createDataFrame(cases, "c long, total long")
    found = df.select("c", "total", divergence.share(F.col("c"), F.col("total")).alias("p")).collect()
    assert {(r.c, r.total): r.p for r in found} == {(c, t): 1 + 10**9 * (c + 1) // t for c, t in cases}
