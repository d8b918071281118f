"""Connected components: the same labels however many edges a task brings together, and no rounds of shuffles for few edges."""

import random

import pytest

from quillpath.llm import common


def labels(edges):
    low = {x: x for e in edges for x in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return {x: low[x] for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("at_once", [1 << 18, 40])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "TREE_EDGES", at_once)
    tables, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df: tables.append(1) or write(df))
    r = random.Random(7)
    chain = r.sample(range(-500, 500), 60)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)] + [(5000, 5000), (2**62, -(2**62)), (2**62, -(2**62))]
    found = common.components(spark.createDataFrame(edges, "a long, b long").repartition(6), "a", "b").collect()
    assert {x.vertex: x.label for x in found} == labels(edges) and len(found) == len({x.vertex for x in found})
    if at_once > len(edges):
        assert len(tables) == 2
    assert common.components(spark.createDataFrame([(3, 3)], "a long, b long"), "a", "b").count() == 0
