"""References found in tables, search over many texts, bounded groups, and pages of results, with edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillpath.operators.queryset import Source
from quillpath.plans import discovery, metadata, search, telemetry
from quillpath.plans.catalog import shop
from quillpath.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_references_need_names_and_values(spark):
    t = {
        "animal": spark.createDataFrame([(k, f"n{k}", k % 3) for k in range(40)], "a_key long, a_name string, a_herd int"),
        "herd": spark.createDataFrame([(k, "h") for k in range(4)], "h_herd long, h_note string"),
        "shoe": spark.createDataFrame([(k, k % 50, k % 3, None if k % 5 else k % 4) for k in range(90)], "s_id long, s_key long, s_kind int, s_herd long"),
        "empty": spark.createDataFrame([], "e_herd long, e_name string"),
    }
    found = discovery.references(t).collect()
    # s_key has values that no animal has; s_kind and a_herd hold values of herds, but s_kind has another name
    assert {(r.source_table, r.source_column, r.target_table, r.target_column) for r in found} == {("animal", "a_herd", "herd", "h_herd"), ("shoe", "s_herd", "herd", "h_herd")}
    assert all(r.orphans == 0 for r in found) and {r["values"] for r in found} == {3, 4}
    about = {(r.table, r.column): r for r in discovery.profile(t).collect()}
    assert about["shoe", "s_herd"].present == 18 and about["empty", "e_name"].rows == 0 and about["animal", "a_key"].high == "39"


def test_one_orphan_is_enough(spark):
    keys = spark.range(5000).withColumnRenamed("id", "a_key")
    rows = spark.range(4000).select(F.when(F.col("id") == 77, 4999).otherwise(F.col("id")).alias("b_key"))
    t = {"a": keys.where("a_key <> 4998"), "b": rows.unionByName(rows.limit(1))}
    assert discovery.references(t).count() == 1
    t["b"] = t["b"].unionByName(spark.createDataFrame([(4998,)], "b_key long"))
    assert discovery.references(t).count() == 0


def test_references_take_few_jobs(spark):
    names = [f"c{i}" for i in range(8)]
    t = {"a": spark.range(50).select(*(F.col("id").alias(f"a_{n}") for n in names)), "b": spark.range(40).select(*((F.col("id") + 1).cast("int").alias(f"b_{n}") for n in names))}
    t["b"] = t["b"].unionByName(t["b"])
    t["d"] = spark.range(60).select(F.least("id", F.lit(58)).alias("d_c0"))  # repeats one value, so it is no key
    spark.sparkContext.setJobGroup("found", "found")
    try:
        found = discovery.references(t)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("found"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in found.collect()} == {("b", f"b_{n}", "a", f"a_{n}", 40, 0, 0.8) for n in names}
    assert jobs < 12  # not some for each pair


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_pairs(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(0, 7)))
    left, right = [word() for _ in range(60)] + ["ABC", "abc", None], [word() for _ in range(60)] + ["abd", None, "z" * 60]
    low = lambda ws: {w.lower() for w in ws if w is not None}
    want = {(a, b, distance(a, b)) for a in low(left) for b in low(right) if a != b and distance(a, b) <= most}
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string")
    found = search.near_pairs(df(left), df(right), "w", most)
    assert {tuple(x) for x in found.collect()} == want and len(want) > 20
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert search.near_pairs(df(left).limit(0), df(right), "w", most).count() == 0


def test_near_pairs_of_numbers_are_not_broadcast(spark):
    words = [f"n#{i:04d}" for i in range(0, 1300, 7)] + ["n#12", "\U0001f600b", "\U0001f601c", "b\U0001f600", "*a", "b*", "x*", "*"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = search.near_pairs(df, df, "w")
    assert sorted(map(tuple, found.collect())) == sorted((a, b, distance(a, b)) for a in words for b in words if a != b and distance(a, b) <= 2)
    # a side of many strings looks small before it is made; sent whole to the driver it does not fit
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_pairs_are_whole_and_single(spark, most):
    # all words of two letters, where a pair can shift both ways, with others of their lengths
    words = ["".join(w) for n in range(7 if most == 2 else 5) for w in itertools.product("ab", repeat=n)] + ["\U0001f600bab", "b\U0001f600ba", "\uff5ebab", "aab\U0001f601", "cccc", "aa\x00", "1,a"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((a, b, distance(a, b)) for a in words for b in words if a != b and distance(a, b) <= most)
    if most == 2:
        assert sorted(map(tuple, search.near_pairs(df, df, "w", most).collect())) == want
        some = df.where("w < 'b'")
        assert sorted(map(tuple, search.near_pairs(some, df, "w", most).collect())) == [x for x in want if x[0] < "b"]
        assert sorted(map(tuple, search.near_pairs(some, df, "w", most, once=True).collect())) == [x for x in want if x[0] < "b" and x[0].encode() < x[1].encode()]
    assert sorted(map(tuple, search.near_pairs(df, df, "w", most, once=True).collect())) == [x for x in want if x[0].encode() < x[1].encode()]


def test_near_pairs_of_many_numbers_are_not_shuffled(spark):
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda es: [es.apply(i) for i in range(es.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    df = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("w"))
    before = shuffled()
    assert search.near_pairs(df, df, "w").where("a < b").count() == 520_908
    # strings that no two words share are not made, and pairs are made where they meet: less than two bytes for each
    assert shuffled() - before < 1_000_000


def test_many_prefixes(spark):
    r = random.Random(3)
    items = ["".join(r.choice("aAb%_") for _ in range(r.randint(0, 6))) for _ in range(200)] + [None]
    asked = ["", "a", "A", "ab", "b%", "zzz", "aaaaaaaaaa", None, "a"]
    frames = spark.createDataFrame([(x,) for x in items], "item string"), spark.createDataFrame([(x,) for x in asked], "prefix string")
    for fold in (False, True):
        cut = (lambda x: x.lower()) if fold else (lambda x: x)
        want = {(p, x, k + 1) for p in {a for a in asked if a is not None} for k, x in enumerate(sorted({i for i in items if i is not None and cut(i).startswith(cut(p))})[:5])}
        assert {tuple(x) for x in search.with_prefixes(frames[0], "item", frames[1], 5, fold).collect()} == want
    assert search.with_prefixes(frames[0], "item", frames[1].limit(0)).count() == 0


def test_recent_latency(spark):
    r = random.Random(4)
    rows = [("a", k // 3, k, r.random()) for k in range(300)] + [("b", 1, 1, 5.0), ("c", 1, 1, None), (None, 2, 2, 7.0)]
    got = {x.g: x for x in telemetry.recent_latency(spark.createDataFrame(rows, "g string, t int, id int, v double"), "g", "v", ["t", "id"], 40).collect()}
    last = sorted(x[3] for x in rows[:300][-40:])
    assert (got["a"]["count"], got["a"].p50, got["a"].p95, got["a"].low, got["a"].high) == (40, last[20], last[38], last[0], last[-1])
    assert got["b"].p95 == 5.0 and got[None].p50 == 7.0 and "c" not in got


def test_prefetch_keeps_some(spark):
    objects = Source(spark, shop(), {"default": SF}).objects
    orders = objects("Order").filter(status="F").order_by("-totalprice")
    rows = objects("Customer").prefetch_related(("orders", orders, 2)).dataframe().collect()
    of = {}
    for o in sorted(orders.dataframe().collect(), key=lambda o: (-o.totalprice, o.orderkey)):
        of.setdefault(o.customer, []).append(o.orderkey)
    assert {r.custkey: sorted(o.orderkey for o in r.orders_rows) for r in rows} == {r.custkey: sorted(of.get(r.custkey, [])[:2]) for r in rows}
    regions = objects("Nation").prefetch_related(("region", objects("Region"), 1)).dataframe().collect()
    assert all(len(r.region_rows) == 1 for r in regions)
    parts = objects("Supplier").prefetch_related(("parts", objects("Part").order_by("-retailprice"), 3)).dataframe().collect()
    assert {len(r.parts_rows) for r in parts} == {3}


def test_chunks(spark):
    objects = Source(spark, shop(), {"default": SF}).objects
    q = objects("Order").order_by("-totalprice", "orderkey").values("orderkey")
    want = [r.orderkey for r in q.dataframe().collect()]
    for size in (1, 7, 400, 10_000):
        limited = q[:50] if size == 1 else q
        chunks = list(limited.chunks(size))
        assert [r.orderkey for c in chunks for r in c] == (want[:50] if size == 1 else want)
        assert all(len(c) == size for c in chunks[:-1]) and len(chunks[-1]) <= size
    assert [r.orderkey for r in q.iterator(chunk_size=999)] == want == [r.orderkey for r in q.iterator()]
    assert list(q.filter(orderkey__lt=0).chunks(5)) == []
    with pytest.raises(ValueError):
        q.chunks(0)


def test_pages_and_chunks_take_few_jobs(spark):
    objects = Source(spark, shop(), {"default": SF}).objects
    q = objects("Order").order_by("-totalprice", "orderkey").values("orderkey")
    want = [r.orderkey for r in q.dataframe().collect()]
    spark.sparkContext.setJobGroup("pages", "pages")
    try:
        paged = sorted((r.number, r.page, r.orderkey) for r in q.paged(3).collect())
        chunks = list(q.chunks(3))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pages"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert paged == [(i, i // 3, k) for i, k in enumerate(want)]
    assert [[r.orderkey for r in c] for c in chunks] == [want[i : i + 3] for i in range(0, len(want), 3)]
    assert jobs < 30 < len(chunks)  # not one for each chunk
    assert q.filter(orderkey__lt=0).paged(5).count() == 0
    with pytest.raises(ValueError):
        q.paged(0)


def test_first_path_to_an_ancestor_is_always_the_same(spark):
    bases = [("D", "A", 0), ("D", "B", 1), ("A", "Base", 0), ("B", "Base", 0), ("D", "Base", 2), ("Base", "Top", 0), ("x", "y", 0), ("y", "x", 0), ("E", "B", 0), ("E", "D", 1)]
    r = random.Random(1)
    for _ in range(3):
        r.shuffle(bases)
        got = {(x.model, x.ancestor): x.way for x in metadata.ancestors(spark.createDataFrame(bases, "model string, base string, ordinal int").repartition(3)).collect()}
        assert got["D", "Base"] == "0000.0000" and got["D", "Top"] == "0000.0000.0000" and got["E", "Base"] == "0000.0000" and got["E", "A"] == "0001.0000"
        assert got["x", "y"] == "0000" and ("x", "x") not in got


def test_updated_after_a_changed_reexport(spark, tmp_path):
    horse = "from django.db import models\n\nclass Horse(models.Model):\n    {} = models.IntegerField()\n"
    project = {
        "farm/__init__.py": "from .a import Horse\n", "farm/a.py": horse.format("height"), "farm/b.py": "from other.models import Horse\n", "other/__init__.py": "", "other/models.py": horse.format("weight"),
        "store/__init__.py": "", "store/models.py": "from django.db import models\nfrom farm import Horse\n\nclass Shoe(models.Model):\n    h = models.ForeignKey(Horse, on_delete=models.CASCADE)\n",
    }
    index = incremental.Index(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([(p, t, False, 1) for p, t in project.items()], incremental.CHANGE), 0)
    old, before = index.build(), metadata.stored(index.modules())
    index.apply(spark.createDataFrame([("farm/__init__.py", "from .b import Horse\n", False, 2)], incremental.CHANGE), 1)
    got, want = index.updated(old, before), metadata.build(index.modules())
    columns = ["model", "name", "kind", "target", "provenance"]
    listed = lambda m: sorted(tuple(str(x) for x in r) for r in m.fields.select(*columns).collect())
    assert listed(got) == listed(want) != listed(old)
    assert {r.target for r in got.fields.where("model = 'store.Shoe' and name = 'h'").collect()} == {"other.Horse"}


def test_fields_of_tables(spark):
    t = {"a": spark.createDataFrame([(1, "x")], "a_key long, a_name string"), "b": spark.createDataFrame([(1, 1, 2.0)], "b_key long, b_from long, b_size double")}
    found = spark.createDataFrame([("b", "b_key", "a", "a_key"), ("b", "b_from", "a", "a_key")], "source_table string, source_column string, target_table string, target_column string")
    got = {(r.model, r.name): (r.kind, r.target) for r in discovery.fields_of(t, found).where("provenance <> 'related_query_alias'").collect()}
    # two references to one table have their columns' names
    assert got == {("a", "key"): ("BigIntegerField", None), ("a", "name"): ("CharField", None), ("b", "key"): ("ForeignKey", "a"), ("b", "from"): ("ForeignKey", "a"), ("b", "size"): ("FloatField", None), ("a", "b_set"): ("reverse_ForeignKey", "b")}
