"""Texts on which polynomial hashes modulo a power of two collide whatever their step."""

from fractions import Fraction

import numpy as np
import pyarrow as pa

from quillpath.llm import common, decontam, ngram_join
from quillpath.llm.queries import tokenizer
from quillpath.llm.tokens import Encoder


def thue_morse(a, b, n=1024):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


TEXTS = [thue_morse("a", "b"), thue_morse("b", "a")]


def test_range_hashes_and_bytes():
    data, offsets = common.utf8(pa.array([*TEXTS, "", "x", "x\0", "\0x", TEXTS[0], "12345678", "123456789", "a" * 64, "a" * 65, "a" * 66]))
    hashes = common.range_hashes(data, offsets[:-1], offsets[1:])
    assert hashes[0] == hashes[6] and len(set(hashes.tolist())) == len(hashes) - 1
    codes, first = common.distinct_ranges(data, offsets[:-1], offsets[1:])
    assert codes[0] == codes[6] and first[codes[6]] == 0 and len(first) == len(hashes) - 1


def test_bytes_decide_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(common, "range_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["ab", "cd", "ab", "e", "cd", *TEXTS, TEXTS[1]]
    data, offsets = common.utf8(pa.array(texts))
    codes, first = common.distinct_ranges(data, offsets[:-1], offsets[1:])
    assert [texts[first[c]] for c in codes] == texts and len(first) == len(set(texts))


def test_encoder_gives_own_ids():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder(tokenizer(name))
        want = [np.array(e.ids, enc.dtype).tobytes() for e in enc.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
        assert enc.encode(TEXTS) == want and want[0] != want[1]


def test_joins_keep_them_apart(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.component_id for r in ngram_join.similar(df, 4, Fraction(85, 100)).collect()} == {0, 1}
    items = spark.createDataFrame([(5, TEXTS[1])], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(df, items).collect()] == [(1, 5)]
