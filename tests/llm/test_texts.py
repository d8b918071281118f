"""Classifiers, extraction, chat and personal data: edge cases, round trips, held-out accuracy, brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillpath.llm import chat, html, langid, pii, quality

SF = "/root/testdata/sf0.01"


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>\n & &amp; &lt;|", "", None, "a<|and|>b<s>|>", "naïve 東京\n\n", "<|user|>\nx"]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a|>b", None]), r.choice(said), "x") for c in range(40) for t in r.sample(range(300), r.randint(1, 12))]
    rows += [(77, t, "assistant", f"t{t}", "x") for t in range(1000)] + [(None, 0, "user", "no id", "x"), (78, None, "user", "n", "x"), (78, 1, "assistant", "m", "x"), (78, 1, "assistant", "m", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(5)
    got = {x.conv_id: x for x in chat.chat_digests(df).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        # ties are sorted by the escaped role and text
        turns.sort(key=lambda x: x[0])
        loss = "".join(t for _, a, t in turns if a == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    made = chat.format_chats(df).where("conv_id = 77").first()
    assert made.formatted.count("<|assistant|>\n") == 1 and made.formatted == "".join(s.text for s in made.segments)
    assert chat.chat_digests(df.limit(0)).collect() == []


def base(t):
    def luhn(n):
        return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(n))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_pii_base(spark):
    r = random.Random(4)
    parts = ["a.b@c.d", "x@y", "@", "%", "q@w.e.r-t", ".", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "300.1.1.1", "001.002.003.04", "1.2.3.4.5", "+1 (017) 555-7713", "+12", "+1234567890123456", " ", "é", "-", "12", "東", "\n", "b@c.d@e.f"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "a" * 200_000 + "@x.y", "1 " * 20_000, "9" * 50_000, "1." * 20_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(4)
    got = {x.doc_id: x for x in pii.span_digests(df.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= {*got[i].spans.split(",")} | ({""} if not want else set())
    assert pii.span_digests(df.limit(0)).collect() == []


def test_pii_more_and_redaction(spark):
    texts = ["call (415) 555-0132 now", "mail: ann (at) home (dot) org please", "amex 3714 496353 98431 ok", "isbn 978-3-16-148410-0", "in 2024-01-15 12:30 we met", "look at this dot here", "the token 04dbebab91ab85687d33eeaaf9ac699e1188f962", "id 9807915762804490 x", "x a@b.co y +1 (017) 555-7713", None, "plain"]
    df = spark.createDataFrame([(i, t, len(t or ""), 5) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, more int")
    got = [x.text for x in pii.redacted(df.drop("more")).orderBy("doc_id").collect()]
    assert got[0] == "call [PHONE] now" and got[1] == "mail: [EMAIL] please" and got[2] == "amex [CARD] ok"
    assert got[3:8] == texts[3:8]
    assert got[8:] == ["x [EMAIL] y [PHONE]", None, "plain"]
    assert [x.n_chars for x in pii.redacted(df.drop("more")).where("doc_id = 8").collect()] == [len(got[8])]


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use</div><header>Site</header>
    <article><header><h1>Head &amp; tail</h1></header><p>One <b>bo<i>ld</b></i>&nbsp; line<br>two<p>Next &lt;x&gt; 1 < 2<script>var a = "</p><p>no";</script><ul><li>a<li>b</ul><form>Search <input></form>
    <aside>Related</aside><table><tr><td>c<td>d</table><section id="comments"><p>Reader says</section></article><div class="ad">Buy</div><footer>Foot</footer></body></html>"""
    assert " ".join(html.lines_of(page)[0]) == "Head & tail One bold line two Next <x> 1 < 2 a b c d"
    assert html.lines_of("<p>cut <b>off</b> <a hre") == (["cut off"], False)
    assert html.lines_of("") == ([], False)
    shared = "<div>Top of host</div><p>{}</p><div>End of host</div>"
    rows = [(1, "http://h/a/1", shared.format("First story")), (2, "http://h/a/2", shared.format("Second story")), (3, "http://g/a", shared.format("Alone")), (4, "http://e/1", None), (5, None, "<p>x</p>"), (6, "http://c/1", "<p>same</p>"), (7, "http://c/2", "<p>same</p>"), (8, "http://h/a/3", "<article><p>Top of host</p></article>")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, text string")
    got = {x.page_id: (x.text, x.n_chars) for x in html.main_text(df).collect()}
    assert got[2] == ("Second story", 12) and got[3][0] == "Top of host Alone End of host" and got[4] == ("", 0) and got[5][0] == "x"
    assert got[6][0] == got[7][0] == "same" and got[8][0] == "Top of host"
    assert html.main_text(df.limit(0)).collect() == []


def test_shared_lines():
    r = random.Random(0)

    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        kept = sorted(html.shared_lines(a, b))
        rest = iter(b)
        assert len(kept) == length(a, b) and all(any(a[i] == y for y in rest) for i in kept)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identified(docs.withColumn("held_out", docs["lang"])).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 ?", "en"), (4, "und die", None), (4, "und die", None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in langid.identified(odd).collect()] == ["und"] * 5
    assert langid.identified(odd.limit(0)).collect() == []


def test_gradients():
    net = langid.Network.new(3)
    for p in ("inputs", "states", "out", "bias"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    rng = np.random.default_rng(0)
    x, mask, y = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.ones((6, 4)), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, mask, y)
    for p, g in zip((net.inputs, net.states, net.out, net.bias), grads, strict=True):
        for at in [tuple(i) for i in np.argwhere(np.abs(g) > 0)[:6]]:
            kept, e = p[at], 1e-3
            p[at] = kept + e
            up = net.gradients(x, mask, y)[0]
            p[at] = kept - e
            down = net.gradients(x, mask, y)[0]
            p[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.scored(docs, labels).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert np.mean([x.predicted == x.quality for x in held]) > 0.9
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 1.0), (None, "text", None)], "doc_id long, text string, score double")
    out = quality.scored(odd, labels.limit(0)).collect()
    assert [x.score for x in out] == [0.5] * 3
    assert quality.scored(odd.limit(0), labels).collect() == []
    assert len(quality.scored(odd, labels.unionByName(labels)).collect()) == 3


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((50, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = {"vectors": v[:40], "labels": rng.integers(0, 2, 40).astype(np.float32), "prior": np.float32(0.5)}
    for row, got in zip(v[40:], quality.vote(v[40:], model), strict=True):
        near = sorted(range(40), key=lambda i: -float(row @ v[i]))[: quality.NEIGHBOURS]
        w = np.array([max(float(row @ v[i]), 0) ** 4 for i in near])
        assert got == pytest.approx(float((w * model["labels"][near]).sum() / w.sum()), abs=1e-5)
