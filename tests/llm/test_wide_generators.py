"""Candidate generators of personal data: gates that lose no match, and common forms proposed and decided."""

import random
import re

from pyspark.sql import functions as F

from quillpath.llm import pii

FORMS = [("phone", "(212)555-1234"), ("phone", "06 12 34 56 78"), ("ip", "2001:db8::1"), ("ip", "::1"), ("email", "john @ example.com"), ("email", "john at example.com")]


def test_gates_are_necessary():
    r = random.Random(5)
    parts = ["john", " ", " at ", "@", "(at)", "[dot]", " dot ", ".", "example", "com", "12", "345", "6789", "(212)", "-", "::", ":", "2001", "db8", "0", "4111", "/", "a"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(3, 12)))
        for kind, pattern, need in pii.GENERATORS:
            if re.search(pattern, t):
                assert re.search(need, t), (kind, t)


def test_common_forms(spark):
    rows = [(i, f"so {t} it is") for i, (_, t) in enumerate(FORMS)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", pii.candidates(F.col("text")).alias("c")).collect()
    for x in got:
        assert FORMS[x.i] in [(c.kind, c.text) for c in x.c], x
    texts = ["call (212)555-1234 now", "tel 06 12 34 56 78 ok", "server 2001:db8::1 is down", "mail: john @ example.com. Then", "write to john at example.com today", "she sat at home. Then it was", "std::vector or a::b", "rows 12 34 56 78 90 of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [x.text for x in pii.redacted(df).orderBy("doc_id").collect()]
    assert out == ["call [PHONE] now", "tel [PHONE] ok", "server [IP] is down", "mail: [EMAIL]. Then", "write to [EMAIL] today", *texts[5:]]
    spans = pii.span_digests(df).where("doc_id = 3").first().spans.split(",")
    assert len(spans) == 1


def test_many_spans(spark):
    """A text of thousands of addresses: places are those of Python's re, and no other span is made of them."""
    import re
    import time

    text = "".join(f"é{i} a{i}@b{i % 7}.org, +1 555 {i % 900 + 100} {i % 9000 + 1000}; " for i in range(4000))
    began = time.time()
    got = pii.with_spans(spark.createDataFrame([(1, text), (2, None), (3, "x@y.zz")], "doc_id long, text string")).select("doc_id", "base", "more").collect()
    spans = {r.doc_id: r for r in got}
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert [(s.start, s.end) for s in spans[1].base if s.kind == "email"] == emails
    assert len([s for s in spans[1].base if s.kind == "phone"]) == 4000 and spans[2].base == [] and len(spans[3].base) == 1
    assert time.time() - began < 120


def test_many_added_spans(spark):
    """Thousands of spans that only generators find, by the plain rule: of overlapping ones the first mark stays and all they cover goes."""
    n = 16_000
    text = "".join(f"\u00e9{i} tel ({i % 900 + 100}) {i % 800 + 100}-{i % 9000 + 1000}; " for i in range(n)) + "\U0001f600" * 5000 + " a@b.cc"
    rows = [(1, text, 0, "x", 1), (2, None, None, None, None), (3, "mail j (at) k.com, +1 555 123 4567 at 10.0.0.1.", 0, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, base string, row int")
    spans = {r.doc_id: [*r.base, *r.more] for r in pii.with_spans(df.select("doc_id", "text")).collect()}
    out = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert len(spans[1]) == n + 1 and spans[2] == []
    for i, t, *_ in rows:
        want, at = [], 0
        for s in sorted(spans[i], key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                want += [t[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        want = "".join([*want, t[at:]]) if t is not None else None
        assert out[i].text == want and out[i].n_chars == (None if t is None else len(want)) and (out[i].base, out[i].row) == (rows[i - 1][3], rows[i - 1][4])


def test_overlaps(spark):
    """Of likely spans that overlap, one stays, and nothing added overlaps a base span."""
    r = random.Random(8)
    parts = [" ", "(212)", "555", "-", "1234", "06 12 34 56 78", "4111 1111 1111 1111", "+1 212 555 1234", "10.1.2.3", "x@y.org", "j at k.com", "(at)", "2001:db8::1", "tel "]
    df = spark.createDataFrame([(i, "".join(r.choice(parts) for _ in range(30))) for i in range(200)], "doc_id long, text string")
    added = 0
    for row in pii.with_spans(df).collect():
        more = sorted((s.start, s.end) for s in row.more)
        added += len(more)
        assert all(a[1] <= b[0] for a, b in zip(more, more[1:], strict=False))
        assert not any(a < s.end and s.start < b for a, b in more for s in row.base)
    assert added > 100
