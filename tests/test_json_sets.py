"""JSON containment at any depth, as a predicate and as a relation, against a recursive definition."""

import json
import random

from pyspark.sql import functions as F

from quillpath.functions import json_sets
from quillpath.functions.lookups import predicate


def holds(big, small, top=True):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(small, dict):
        return isinstance(big, dict) and all(k in big and holds(big[k], v, False) for k, v in small.items())
    if isinstance(small, list):
        return isinstance(big, list) and all(any(holds(b, s, False) for b in big) for s in small)
    if top and isinstance(big, list):
        return any(holds(b, small, False) for b in big)
    if number(big) and number(small):
        return big == small
    return type(big) is type(small) and big == small


def value(r, depth):
    kind = r.random()
    if depth and kind < 0.35:
        return {r.choice(["a", "b", "c'd", 'e"f', "g.h", ""]): value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if depth and kind < 0.65:
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice([0, 1, 1.0, 1.5, -2, True, False, None, "", "1", "x", 10**17 + 1, 10**17, 1e300])


def part(r, v):
    """Something that v often contains."""
    if isinstance(v, dict):
        return {k: part(r, x) for k, x in v.items() if r.random() < 0.7}
    if isinstance(v, list):
        out = [part(r, x) for x in v if r.random() < 0.8]
        r.shuffle(out)
        return out + out[:1]
    return v


BIG = [value(random.Random(k), 4) for k in range(60)]


def test_literals(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(BIG)] + [(100, None), (101, "{bad")], "k int, j string")
    r, found, none = random.Random(1), 0, 0
    needles = [part(r, BIG[k]) for k in range(0, 60, 3)] + [{}, [], None, True, 1, "x", {"a": []}]
    columns = [predicate(name, F.col("j"), n, "JSONField").alias(f"{name}{i}") for i, n in enumerate(needles) for name in ("contains", "contained_by")]
    for row in df.select("k", *columns).collect():
        for i, n in enumerate(needles):
            there = row.k < 100
            assert row[f"contains{i}"] == (there and holds(BIG[row.k], n)), (row.k, n)
            assert row[f"contained_by{i}"] == (there and holds(n, BIG[row.k])), (row.k, n)
            found, none = found + row[f"contains{i}"], none + (not row[f"contains{i}"])
    assert found > 50 and none > 50


def test_columns(spark):
    r = random.Random(2)
    pairs = [(BIG[k], part(r, BIG[k]) if k % 2 else BIG[(k * 7 + 1) % 60]) for k in range(60)] + [([1, [2, {"a": [3]}]], [{}]), ([1, [2, {"a": [3]}]], [[{"a": [3]}]]), ([1], 1), ([[1]], 1), ({"a": 1}, {"a": 1, "b": 2})]
    rows = [(k, json.dumps(b), json.dumps(s)) for k, (b, s) in enumerate(pairs)] + [(900, None, "1"), (901, "1", None), (902, "{", "{}")]
    got = {x.k: x.contained for x in json_sets.contained(spark.createDataFrame(rows, "k int, big string, small string"), "k", "big", "small").collect()}
    assert got == {k: holds(b, s) for k, (b, s) in enumerate(pairs)} | dict.fromkeys((900, 901, 902), False)
    assert len(set(got.values())) == 2
    none = spark.createDataFrame([], "k int, big string, small string")
    assert json_sets.contained(none, "k", "big", "small").count() == 0


def test_columns_of_shallow_values_take_one_pass(spark, monkeypatch):
    r = random.Random(4)
    deep = {"a": [{"a": [[{"a": [1, [2, {"a": 3}]]}]]}]}
    pairs = [(BIG[k], part(r, BIG[k]) if k % 2 else BIG[(k * 7 + 1) % 60]) for k in range(60)] + [(deep, deep), (deep, {"a": [{"a": [[{"a": [[{"a": 4}]]}]]}]}), ({"a": [deep, deep]}, {"a": [{"x": 1}, deep]})]
    df = spark.createDataFrame([(k, json.dumps(b), json.dumps(s)) for k, (b, s) in enumerate(pairs)], "k int, big string, small string")
    by_levels, seen = json_sets._by_levels, []
    monkeypatch.setattr(json_sets, "_by_levels", lambda rows: seen.append(sorted(x.key for x in rows.select("key").collect())) or by_levels(rows))
    found = lambda rows: {x.k: x.contained for x in json_sets.contained(rows, "k", "big", "small").collect()}
    want = {k: holds(b, s) for k, (b, s) in enumerate(pairs)}
    assert found(df) == want and {60, 61} <= set(seen[0])
    monkeypatch.setattr(json_sets, "DEPTH", 1)
    assert found(df) == want and len(seen[1]) > len(seen[0])
    shallow = df.where("k < 60 and length(big) < 30")
    monkeypatch.setattr(json_sets, "DEPTH", 4)
    assert found(shallow) == {x.k: want[x.k] for x in shallow.collect()} and len(seen) == 2
