"""Merkle manifest against a plain tree, with edge cases."""

import random
import zlib
from hashlib import sha256

import pytest

from quillpath.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    """The root, and for each digest its place and the other members of its runs."""
    level, at, proofs = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for k, p in enumerate(proofs):
            run, place = runs[at[k] // 3], at[k] % 3
            p.append((place, run[:place] + run[place + 1 :]))
            at[k] //= 3
        level = [h(*r) for r in runs]
    return level[0], proofs


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, proofs = {}, {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subs[s], proofs[s] = tree([leaf(r, r[4]) for r in by[s]])
    root, above = tree([subs[s] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for row, own in zip(by[s], proofs[s], strict=True):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for place, others in own + up:
                folded = h(*others[:place], folded, *others[place:])
            out.append((row[0], leaf(row, row[4]), subs[s], root, h(*(x for _, o in own + up for x in o)), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.audited(df).collect()), key=str)


def rows_of(n, sources, seed):
    r = random.Random(seed)
    return [(k * 7 - 20, r.choice(sources), r.choice(["en", None]), r.choice([None, k]), r.choice([None, "", "a\nb", "ünï\n\ncode", "plain", "x" * 5000 + "\n"])) for k in range(n)]


def test_against_plain_tree(spark, monkeypatch):
    """One source holds most rows and is cut into many ranges; ends meet in several rounds."""
    rows = rows_of(700, ["big"] * 30 + [None, "", "a", "b", "ü", "Z"], 1)
    monkeypatch.setattr(manifest, "LEVELS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("n", [1, 4, 10])
def test_small(spark, n):
    rows = rows_of(n, ["only"], n)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 3, "a\nb"), (4, "s", "en", 3, "a\nb"), (4, "s", "en", 3, "a\nb"), (4, "s", "en", 3, "other"), (5, "", "en", 3, "")]
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA + ", root string, _index int, leaf string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_proofs_lead_to_the_root(spark):
    rows = rows_of(60, ["a", "b", "c", "d"], 3)
    made = manifest.manifest(manifest.leaves(spark.createDataFrame(rows, SCHEMA)), proofs=True).collect()
    assert len(made) == 60
    for r in made:
        where = (r.place, r.places), (r.source_place, r.sources)
        assert manifest.fold(r.leaf, r.proof, where) == r.root
        assert manifest.fold(r.leaf[::-1], r.proof, where) != r.root
        assert h(r.proof) == r.proof_sha256


def test_leaves_without_proofs_are_not_broken_by_part_size(spark):
    rows = rows_of(90, ["a", "b"], 4)
    df = manifest.leaves(spark.createDataFrame(rows, SCHEMA))
    one, many = (sorted((r.doc_id, r.root, r.proof_sha256) for r in manifest.manifest(df, part_rows=n).collect()) for n in (10**6, 4))
    assert one == many
