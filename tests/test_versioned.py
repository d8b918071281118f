"""Versioned tables: what is rewritten, what readers see, what a dead or a second writer leaves; views and file streams over them."""

import pytest
from pyspark.sql import functions as F

from quillpath.operators.queryset import Source
from quillpath.functions.expressions import F_
from quillpath.plans.catalog import shop
from quillpath.sources.versioned import Conflict, VersionedTable
from quillpath.streaming.files import follow_files
from quillpath.streaming.views import SumView, joined, signed

SF = "/root/testdata/sf0.001"


@pytest.fixture
def orders(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    table = VersionedTable(spark, str(tmp_path / "orders"))
    table.create(df.repartitionByRange(8, "o_orderkey"))
    return df, table


def rows(df):
    return sorted(map(str, df.collect()))


def test_update_rewrites_only_files_that_hold_a_hit(spark, orders):
    df, table = orders
    before = table.version()
    assert len(before.files) == 8
    top = df.agg(F.expr("percentile(o_orderkey, 0.01)")).first()[0]
    number = table.update(F.col("o_orderkey") <= top, {"o_totalprice": F.col("o_totalprice") * 2})
    after = table.version(number)
    assert len(set(before.files) - set(after.files)) == 1 and len(set(before.files) & set(after.files)) == 7
    want = df.withColumn("o_totalprice", F.when(F.col("o_orderkey") <= top, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    assert rows(table.read()) == rows(want) and rows(table.read(0)) == rows(df)
    feed = table.changes(0)
    assert feed.where("sign = 1").count() == feed.where("sign = -1").count() == df.where(F.col("o_orderkey") <= top).count()
    # nothing to change makes no version
    assert table.delete(F.col("o_orderkey") < -5) == number
    assert table.update(F.lit(None).cast("boolean"), {"o_totalprice": F.lit(0)}) == number


def test_readers_keep_their_version_and_vacuum(spark, orders):
    df, table = orders
    reader = VersionedTable(spark, table.folder).read()
    table.delete(F.col("o_orderstatus") == "F")
    assert reader.count() == df.count()
    assert table.read().count() == df.where("o_orderstatus <> 'F'").count() == VersionedTable(spark, table.folder).read().count()
    gone = table.vacuum()
    assert gone and table.versions() == [1] and table.read().count() == df.where("o_orderstatus <> 'F'").count()
    with pytest.raises(KeyError):
        table.read(0)


def test_a_second_writer_and_a_dead_one(spark, orders, monkeypatch):
    df, table = orders
    other = VersionedTable(spark, table.folder)
    stale = other.version()
    table.append(df.limit(3))
    with monkeypatch.context() as m:
        m.setattr(other, "version", lambda number=None: stale)
        with pytest.raises(Conflict):
            other.append(df.limit(5))
    assert table.versions() == [0, 1] and table.read().count() == df.count() + 3
    with monkeypatch.context() as m:
        m.setattr(other, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            other.append(df.limit(5))
    assert table.read().count() == df.count() + 3
    assert other.append(df.limit(5)) == 2
    assert len(table.vacuum(keep=3)) >= 1 and table.read().count() == df.count() + 8


def test_merge(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, v double").repartitionByRange(3, "k"))
    new = spark.createDataFrame([(2, 20.0, False), (None, 5.0, False), (3, 3.0, False), (1, 0.0, True), (9, 0.0, True)], "k int, v double, gone boolean")
    number = table.merge(new, ["k"], remove="gone")
    assert sorted((tuple(r) for r in table.read().collect()), key=str) == sorted([(2, "b", 20.0), (None, "n", 5.0), (3, None, 3.0)], key=str)
    assert number == 1
    with pytest.raises(ValueError):
        table.merge(new.unionByName(new), ["k"])


def test_queries_write(spark, orders):
    df, table = orders
    source = Source(spark, shop(), {"default": SF}, versioned={"orders": table})
    O = source.objects  # noqa: N806, E741
    O("Order").filter(status="F", totalprice__gt=1000).update_rows(totalprice=F_("totalprice") + 1, priority="LOW")
    hit = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)
    want = df.withColumns({"o_totalprice": F.when(hit, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(hit, "LOW").otherwise(F.col("o_orderpriority"))})
    assert rows(table.read()) == rows(want)
    # by another table's rows: keys
    O("Order").filter(customer__nation__name__startswith="A").delete_rows()
    nation = spark.read.parquet(f"{SF}/nation.parquet").where("n_name like 'A%'")
    gone = spark.read.parquet(f"{SF}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    want = want.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    assert rows(table.read()) == rows(want) and O("Order").count() == want.count()
    first = want.orderBy("o_orderkey").first()
    O("Order").create_rows([{"orderkey": first.o_orderkey, "status": "X"}, {"orderkey": -1, "status": "N"}], ignore_conflicts=True)
    O("Order").create_rows([{"orderkey": first.o_orderkey, "status": "U", "priority": "no"}, {"orderkey": -2, "status": "N"}], update_fields=("status",))
    got = {r.o_orderkey: (r.o_orderstatus, r.o_orderpriority) for r in table.read().where(F.col("o_orderkey").isin(first.o_orderkey, -1, -2)).collect()}
    assert got == {first.o_orderkey: ("U", first.o_orderpriority), -1: ("N", None), -2: ("N", None)}
    with pytest.raises(ValueError):
        O("Customer").filter(custkey=1).delete_rows()


def test_sums_follow_changes(spark, orders, tmp_path):
    df, _ = orders
    view = SumView(VersionedTable(spark, str(tmp_path / "view")), ["o_custkey"], {"total": "o_totalprice"})
    view.build(df)
    old, new = df.where("o_orderkey % 7 = 0"), df.where("o_orderkey % 7 = 0").where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 5)
    more = df.where("o_orderkey % 11 = 0").withColumn("o_custkey", F.lit(None).cast("long"))
    change = signed(new.unionByName(more), old)
    view.apply(change, batch=0)
    view.apply(change, batch=0)
    after = df.exceptAll(old).unionByName(new).unionByName(more)
    want = {(r.o_custkey, r.n, round(r.t, 2)) for r in after.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t")).collect()}
    assert {(r.o_custkey, r.n, round(float(r.total), 2)) for r in view.read().collect()} == want
    view.apply(signed(df.limit(0), after), batch=1)
    assert view.read().count() == 0


def test_changes_through_a_join(spark):
    a, b = (spark.createDataFrame(x, s) for x, s in (([(1, "x"), (2, "y"), (2, "z")], "k int, a string"), ([(1, 10), (2, 20), (3, 30)], "k int, b int")))
    da = signed(spark.createDataFrame([(3, "w"), (1, "v")], "k int, a string"), spark.createDataFrame([(2, "y")], "k int, a string"))
    db = signed(spark.createDataFrame([(1, 11)], "k int, b int"), spark.createDataFrame([(2, 20)], "k int, b int"))
    total = signed(a.join(b, "k")).unionByName(joined(a, da, b, db, ["k"])).groupBy("k", "a", "b").agg(F.sum("sign").alias("n")).where("n <> 0")
    assert {tuple(r) for r in total.collect()} == {(1, "x", 10, 1), (1, "x", 11, 1), (1, "v", 10, 1), (1, "v", 11, 1), (3, "w", 30, 1)}


def test_file_stream_survives_a_kill(spark, orders, tmp_path):
    df, _ = orders
    folder, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    df.repartitionByRange(5, "o_orderkey").write.parquet(folder)
    table = VersionedTable(spark, str(tmp_path / "out"))
    commit, calls = table._commit, []

    def dies(*args):  # before the third commit, and after the fourth
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed before its commit")
        commit(*args)
        if len(calls) == 5:
            raise RuntimeError("killed after its commit")
        return args[0] + 1

    table._commit = dies
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            follow_files(spark, folder, df.schema, table, at).awaitTermination()
    follow_files(spark, folder, df.schema, table, at).awaitTermination()
    assert rows(table.read()) == rows(df) and table.version().number == 4 and table.version().done == {"files": 4}
    assert len(calls) == 6


def test_rows_are_saved(spark, orders):
    _, table = orders
    source = Source(spark, shop(), {"default": SF}, versioned={"orders": table})
    q = source.objects("Order")
    row = q.order_by("orderkey").first()
    files = set(table.version().files)
    q.save({"orderkey": row.orderkey, "status": "Z"})
    assert len(files - set(table.version().files)) == 1
    fresh = source.objects("Order").refresh_from_db(row)
    assert fresh.asDict() == {**row.asDict(), "status": "Z"}
    assert source.objects("Order").refresh_from_db(row, ("priority",)).status == row.status
    q.save(row, update_fields=("priority",))
    assert source.objects("Order").get(orderkey=row.orderkey).status == "Z"
    with pytest.raises(ValueError):
        q.save(row, force_insert=True)
    with pytest.raises(LookupError):
        q.save({"orderkey": -7, "status": "Z"}, force_update=True)
    with pytest.raises(ValueError):
        q.save({"status": "Z"})
    with pytest.raises(NotImplementedError):
        source.objects("Customer").save({"custkey": 1})
    q.remove(row)
    with pytest.raises(LookupError):
        source.objects("Order").refresh_from_db(row)
