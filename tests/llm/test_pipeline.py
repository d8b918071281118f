"""Every stage of the pipeline against a brute-force version, on its own input."""

import re
from fractions import Fraction

import corpus_pipeline
from quillpath.llm.common import written

from .test_pairs_and_leaks import components, leaks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF)))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:5]]
    assert all(d.columns == columns for d in seen[:5])
    kept = texts[1].keys()
    assert sum((d in kept) == bool(q) for d, q in labels.items()) >= 0.9 * len(labels)
    want = components(list(texts[1].items()), 5, Fraction(4, 5))
    assert texts[2].keys() == {d for d, (_, c) in want.items() if c == d}
    bad = {d for d, *_ in leaks(list(texts[2].items()), items)}
    assert texts[3].keys() == texts[2].keys() - bad
    assert texts[4].keys() == texts[3].keys()
    for d, t in texts[4].items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        if t != texts[3][d]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", t)
    assert {r.doc_id for r in seen[5].collect()} == texts[4].keys()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.isEmpty()


def test_extra_columns_and_nulls(spark):
    rows = [(1, "fine words here and there " * 8, None, None, 1, 0.1, 2), (2, None, None, None, None, None, None), (None, "fine words again and again " * 8, "en", "s", 5, 0.2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
