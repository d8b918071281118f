"""Near duplicates and decontamination against brute force, with edge cases."""

import random
import re
from fractions import Fraction

import duckdb
import pytest

from quillpath.llm import decontam, digests, ngram_join

DOCS = "doc_id long, text string, sid string, label int"


def words_of(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def components(docs, width, t):
    sets = {}
    for d, text in docs:
        sets.setdefault(d, set()).update(shingles(text, width))
    ids = list(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * t.denominator >= len(sets[a] | sets[b]) * t.numerator:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    r = random.Random(7)
    docs, n = [], 0
    common = words_of(40, 999)
    for g in range(14):
        base = words_of(r.choice([1, 2, 3, 5, 12, 40, 150, 400]), g)
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([["new"], [], [w[k], "more"]])
            if r.random() < 0.2:
                w = common + w
            docs.append((n, " ".join(w)))
            n += 1
    # a chain in which only neighbours are linked, and a group whose members are near their original alone
    chain = words_of(120, 5)
    for i in range(12):
        docs.append((n, " ".join(chain[i * 2 : i * 2 + 90])))
        n += 1
    star = words_of(200, 6)
    docs.append((n, " ".join(star)))
    for i in range(60):
        w = list(star)
        for k in (i * 3, i * 3 + 1, 199 - i):
            w[k] = f"x{i}y{k}"
        docs.append((n + 1 + i, " ".join(w)))
    n += 70
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One"), (n + 4, "oNE"), (n + 5, "a b c"), (n + 6, "A  B\tC"), (n + 7, "word " * 3000)]
    return docs


@pytest.mark.parametrize(("width", "t"), [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_components(spark, monkeypatch, width, t):
    docs = corpus()
    df = spark.createDataFrame([(d, x, "clash", 1) for d, x in docs], DOCS).repartition(5)
    want = components(docs, width, t)
    for few in (48, 2):  # with small buckets joined, and with almost all compared in blocks
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "BLOCK", 7 if few == 2 else 2048)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(df, width, t).collect()}
        assert got == want


def test_join_edges(spark):
    assert ngram_join.similar(spark.createDataFrame([], DOCS)).collect() == []
    same = spark.createDataFrame([(3, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (9, None, None, None)], DOCS)
    got = ngram_join.similar(same).collect()
    assert sorted((str(r.doc_id), r.component_id, r.component_size) for r in got) == [("3", 3, 3), ("3", 3, 3), ("9", 9, 1), ("None", 3, 3)]


def leaks(docs, items, t=0.8):
    words = lambda x: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    wanted = {}
    for i, y in items:
        w = words(y)
        wanted.setdefault(i, set()).update(runs(w, 5) if len(w) >= 5 else {tuple(w)} - {()})
    out = []
    for d, x in docs:
        w = words(x)
        held = set().union(*(runs(w, k) for k in range(1, 6)))
        out += [(d, i, len(s), len(s & held)) for i, s in wanted.items() if s and len(s & held) >= t * len(s)]
    return sorted(out)


def test_leaks(spark):
    items = [(i, " ".join(words_of(n, 100 + i))) for i, n in enumerate([5, 6, 9, 16, 30, 50, 50])] + [(50, None), (51, "too few"), (52, ""), (53, "four words are here"), (54, "Solo")]
    # items of several rows, of which one may be short or a part of another
    items += [(60, "a b c d e f"), (60, "a b c d e"), (61, "p q r s t u v"), (61, "w x"), (62, " ".join(words_of(60, 71))), (62, " ".join(words_of(60, 71)[:30]))]
    docs = [(0, None), (1, ""), (2, "none here"), (3, "it is too FEW, of them solo"), (4, "all four  words are here now")]
    docs += [(5, "x a b c d e f y"), (5, "x a b c d e f y"), (6, "p q r s t u v, w x"), (6, "p q r s t u v w"), (7, " ".join(words_of(60, 71)[:54]))]
    for k, (i, y) in enumerate(items[:7]):
        long = words_of(8000 if k == 3 else 300, 500 + k)
        docs.append((10 + i, " ".join(long[:150]) + ".\n" + y.upper() + "! " + " ".join(long[150:])))
        w = y.split()
        w[len(w) // 2] = "changed"
        docs.append((30 + i, " ".join(long[:50] + w + long[50:])))
        docs.append((60 + i, " ".join(w[: len(w) // 2])))
    df = spark.createDataFrame([(d, x, "clash", 1) for d, x in docs], "doc_id long, text string, item_id string, size int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = leaks(docs, items)
    assert len(want) >= 7 and len(set(want)) < len(want) and {51, 53, 54, 60, 61, 62} <= {i for _, i, *_ in want}
    for most in (decontam.BROADCAST_SHINGLES, 3):  # broadcast, and joined by a shuffle
        got = decontam.contaminated(df, bench, broadcast_shingles=most)
        assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()) == want
    assert decontam.contaminated(df, bench.limit(0)).collect() == []
    assert decontam.contaminated(df.limit(0), bench).collect() == []


@pytest.mark.parametrize("name", ["op1_decontamination", "op6_ngram_join"])
def test_sql(spark, name):
    from quillpath.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    rel = c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    names = rel.columns
    assert sorted(tuple(r[k] for k in columns) for r in got.collect()) == sorted(tuple(r[names.index(k)] for k in columns) for r in rel.fetchall())


def test_digests(spark):
    import hashlib

    docs = [(5, "Ａ  Café x"), (4, "a CAFÉ x"), (9, None), (1, ""), (7, "straße"), (6, "STRASSE"), (2, "x" * 70_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, next int")
    got = {r.doc_id: r for r in digests.digests(df).collect()}
    assert got[5].fingerprint == got[4].fingerprint and got[7].fingerprint == got[6].fingerprint and got[9].fingerprint == got[1].fingerprint
    assert got[5].near_next == 1 and got[5].copies == 2 and got[5].copy_of == 4 and got[2].copies == 1
    order = sorted(docs, reverse=True)
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()
        assert got[d].n_chars == len(t)
    assert digests.digests(df.limit(0)).collect() == []
    twice = digests.digests(spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "b", 0)], "doc_id long, text string, next int")).collect()
    assert len(twice) == 3
