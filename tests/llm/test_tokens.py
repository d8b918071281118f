"""Token store and packing against the tokenizers themselves."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillpath.llm import packing, token_store, tokens
from quillpath.llm.queries import tokenizer

WORD, BYTE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b\n\n c ", "don't I'll x's", "x<|endoftext|> y  <|startoftext|>", " tab\t \x1cé é ñ東京 ", "x" * 3000, "1234 5.6,7 ###", "Ünïcode, wörds! ΑΣ İ"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_tokenizer(path):
    r = random.Random(3)
    letters = " \n\t  \xa0\x1c\x85　ab'sé,.1²İΣ́東<|endoftext|>'re"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    whole, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [np.frombuffer(b, enc.dtype).tolist() for i in range(0, len(texts), 100) for b in enc.encode(texts[i : i + 100])]
    assert got == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    levels, words, ranks = token_store.perfect_hash(keys)
    assert sorted(token_store.slots(keys, levels, words, ranks)) == list(range(len(keys)))
    assert token_store.perfect_hash(keys[:0])[0] == []


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 500)
    docs = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(10_000 + i, f"word{i} again " * (i % 9)) for i in range(300)]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, part string").repartition(3)
    path = str(tmp_path / "store")
    token_store.write_store(df, path, WORD, 1)
    whole, start = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in token_store.stored_digests(df, path).collect()}
    ids = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids[d] = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    some = spark.createDataFrame([(d,) for d in (-20, 10_005, 10_299, 5, 99_999, -1)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_store.fetch(spark, path, some).collect()} == {d: ids[d] for d in (-20, 10_005, 10_299)}


def test_store_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(empty, str(tmp_path / "a"), WORD, 1)
    assert token_store.stored_digests(empty, str(tmp_path / "a")).collect() == []
    odd = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    token_store.write_store(odd, str(tmp_path / "b"), WORD, 1)
    got = token_store.stored_digests(odd, str(tmp_path / "b")).collect()
    assert sorted((str(r.doc_id), r.start) for r in got) == [("4", 2), ("4", 2), ("None", 0)]


def test_packing(spark):
    r = random.Random(2)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join("w%d" % r.randint(0, 99) for _ in range(r.randint(0, 120)))) for i in range(400)] + [(900, "long text " * 4000), (901, None), (902, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, piece int").repartition(4)
    out = packing.pack_documents(df, BYTE, 256, 0, keep_ids=True)
    rows = out.collect()
    whole, total, at = Tokenizer.from_file(BYTE), 0, {}
    for row in rows:
        at.setdefault(row.doc_id, []).append(row)
    for d, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        cut = sorted(at[d], key=lambda x: x.piece)
        assert [x.piece for x in cut] == list(range(len(cut))) and [x.length for x in cut[1:]] == [256] * (len(cut) - 1)
        assert sum(x.length for x in cut) == len(ids) and all(x.ids_crc32 == crc(ids[x.start : x.start + x.length]) for x in cut)
        total += len(ids)
    made = {}
    for row in rows:
        made.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in made.values():
        place = 0
        for o, n in sorted(parts):
            assert o == place
            place += n
        assert place <= 256
    assert len(made) <= 1.04 * total / 256
    joined = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert sum(len(x) for x in joined.values()) == 2 * total
    assert packing.pack_documents(df.limit(0), BYTE, 256).collect() == []


def test_plan_fills_exactly():
    for lengths in ({3: 4, 7: 4}, {2: 5, 3: 5, 5: 5}, {1: 2, 2: 2, 3: 2, 4: 2}, {9: 3, 1: 1}, {10: 2}, {6: 5}):
        made = packing.plan(lengths, 10)
        back = {}
        for pattern, n in made:
            assert sum(pattern) <= 10 and n > 0
            for x in pattern:
                back[x] = back.get(x, 0) + n
        assert back == lengths
    assert sum(n for _, n in packing.plan({1: 2, 2: 2, 3: 2, 4: 2}, 10)) == 2


def fitted(lengths, capacity):
    """Best fit in falling length, piece by piece: how many sequences."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return len(rooms)


def least(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_plan_against_brute_force():
    r = random.Random(8)
    more = 0
    for _ in range(300):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        made = packing.plan({x: lengths.count(x) for x in lengths}, 20)
        assert sorted(x for p, n in made for x in p * n) == sorted(lengths) and all(sum(p) <= 20 for p, _ in made)
        more += sum(n for _, n in made) - least(sorted(lengths, reverse=True), 20)
        many = [r.randint(1, 20) for _ in range(200)]
        assert sum(n for _, n in packing.best_fit({x: many.count(x) for x in many}, 20)) == fitted(many, 20)
    assert more <= 12


def test_packing_deals_out_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rows = [(i, 0, 0, x, 0, "clash") for i, x in enumerate([5] * 60 + [3] * 40 + [7] * 9)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, offset string"), 10).collect()
    made = {}
    for x in out:
        made.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert len(out) == 109 and all(sum(n for o, n in sorted(v)[:k]) == sorted(v)[k][0] for v in made.values() for k in range(len(v))) and max(sum(n for _, n in v) for v in made.values()) <= 10
