import asyncio

import pytest
from pyspark.sql import functions as F

from quillpath.functions.expressions import ArrayAgg, Count, F_, Q, Sum, Value
from quillpath.operators.queryset import DoesNotExist, MultipleObjectsReturned, Source
from quillpath.plans.catalog import Catalog, Field, Model, shop
from quillpath.plans.paths import PathError, resolve

CATALOG = Catalog(
    {
        m.label: m
        for m in (
            Model("a.Owner", "owner", "id", (Field("id", "BigAutoField", "id"), Field("name", "CharField", "name"))),
            Model("a.Pet", "pet", "id", (Field("id", "BigAutoField", "id"), Field("owner", "ForeignKey", "owner_id", "a.Owner", "pets"), Field("kind", "CharField", "kind"), Field("age", "IntegerField", "age"), Field("facts", "JSONField", "facts"))),
        )
    }
)


@pytest.fixture
def objects(spark):
    owners = spark.createDataFrame([(1, "Ann"), (2, None), (3, "Cy")], "id long, name string")
    pets = spark.createDataFrame([(1, 1, "cat", 3, '{"a":1,"b":{"c":2}}'), (2, 1, "dog", None, None), (3, 2, "cat", 5, '{"a":null}'), (4, None, None, 7, "{}")], "id long, owner_id long, kind string, age int, facts string")
    return Source(spark, CATALOG, {}, {"owner": owners, "pet": pets}).objects


def ids(q):
    return sorted(r[0] for r in q.values("id").dataframe().collect())


def test_nulls_in_filters(objects):
    assert ids(objects("Pet").filter(kind=None)) == [4]
    assert ids(objects("Pet").exclude(kind="cat")) == [2, 4]
    assert ids(objects("Pet").exclude(age__gt=4)) == [1, 2]
    assert ids(objects("Pet").filter(owner__name__isnull=True)) == [3, 4]
    assert ids(objects("Pet").filter(kind__in=["cat", None])) == [1, 3]
    assert ids(objects("Pet").filter(age__in=[])) == []
    assert ids(objects("Pet").filter(~Q(age=3))) == [2, 3, 4]


def test_outer_side_stays(objects):
    assert ids(objects("Owner").exclude(pets__kind="cat")) == [3]
    assert ids(objects("Owner").filter(pets__isnull=True)) == [3]
    rows = objects("Owner").annotate(n=Count("pets"), years=Sum("pets__age"), kinds=ArrayAgg("pets__kind")).dataframe().collect()
    assert sorted((r.id, r.n, r.years) for r in rows) == [(1, 2, 3), (2, 1, 5), (3, 0, None)]


def test_json(objects):
    assert ids(objects("Pet").filter(facts__contains={"a": 1})) == [1]
    assert ids(objects("Pet").filter(facts__has_key="a")) == [1, 3]
    assert ids(objects("Pet").filter(facts__b__c="2")) == [1]
    assert ids(objects("Pet").filter(facts__contained_by={"z": 1})) == [4]


def test_get_and_first(objects):
    assert objects("Pet").get(id=3).age == 5
    with pytest.raises(DoesNotExist):
        objects("Pet").get(id=30)
    with pytest.raises(MultipleObjectsReturned):
        objects("Pet").get(kind="cat")
    assert objects("Pet").first().id == 1 and objects("Pet").last().id == 4
    assert objects("Pet").in_bulk([1, 9]).keys() == {1}
    assert objects("Pet").contains(2) and not objects("Pet").filter(age__gt=100).exists()
    assert asyncio.run(objects("Pet").acount()) == 4


def test_writes(objects):
    q = objects("Pet").filter(owner__name="Ann")
    assert sorted((r.id, r.age) for r in q.update(age=F_("age") + 1).collect()) == [(1, 4), (2, None), (3, 5), (4, 7)]
    assert sorted(r.id for r in q.delete().collect()) == [3, 4]
    made, new = objects("Pet").get_or_create(id=9, defaults={"kind": "newt"})
    assert new and made.count() == 5
    assert objects("Pet").bulk_create([{"id": 1, "kind": "x"}, {"id": 8}], update_conflicts=True, update_fields=("kind",)).where("kind = 'x' or id = 8").count() == 2
    with pytest.raises(PathError):
        objects("Pet").create(owner__name="x")


def test_plan_prunes_and_shares_joins(spark):
    q = Source(spark, shop(), {"default": "/root/testdata/sf0.001"}).objects("LineItem").filter(order__customer__name="x", order__status="F", quantity__gt=3).values("order__customer__acctbal")
    plan = q.explain()
    assert plan.count("Location: ") == 3
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,3" in plan and "l_comment" not in plan


@pytest.mark.parametrize(
    ("model", "path", "method", "reason"),
    [
        ("a.Pet", "", "filter", "empty"), ("a.Pet", "owner____name", "filter", None), ("a.Pet", "owner__pk__in", "filter", None), ("a.Pet", "owner_id__gt", "filter", None), ("a.Pet", "owner__isnull", "filter", None),
        ("a.Pet", "age__icontains", "filter", "invalid_lookup_operator"), ("a.Pet", "kind__x", "values", "non_relation_intermediate"), ("a.Pet", "owner__zip", "only", "segment_not_found"), ("a.Pet", "kind", "select_related", "relation_required"),
        ("a.Owner", "pets", "prefetch_related", None), ("a.Owner", "pets__kind__upper__startswith", "filter", None), ("a.Pet", "-age", "order_by", None), ("a.Pet", "nope", "filter", "segment_not_found"),
    ],
)
def test_paths(model, path, method, reason):
    if reason is None:
        assert resolve(CATALOG, model, path, method)
    else:
        with pytest.raises(PathError) as e:
            resolve(CATALOG, model, path, method)
        assert e.value.reason == reason


def test_alias_is_hidden_and_virtual_paths(objects):
    q = objects("Pet").alias(x=Value(2)).annotate(y=F_("x") + 1)
    assert "x" not in q.dataframe().columns and q.filter(y__gte=3).count() == 4
    with pytest.raises(PathError):
        q.filter(y__owner=1)


def test_empty_tables(spark):
    none = {"owner": spark.createDataFrame([], "id long, name string"), "pet": spark.createDataFrame([], "id long, owner_id long, kind string, age int, facts string")}
    objects = Source(spark, CATALOG, {}, none).objects
    assert objects("Owner").annotate(n=Count("pets")).count() == 0
    assert objects("Pet").aggregates(n=Count("*"), s=Sum("age")).collect()[0] == (0, None)
    assert objects("Pet").first() is None
    assert objects("Pet").dataframe().agg(F.count("*")).first()[0] == 0


def test_writes_by_the_row_itself_need_no_join(spark):
    orders = Source(spark, shop(), {"default": "/root/testdata/sf0.001"}).objects
    joins = lambda df: "Join" in df._jdf.queryExecution().optimizedPlan().toString()
    customers = orders("Customer")
    own = customers.filter(acctbal__lt=0).exclude(mktsegment="BUILDING")
    far = customers.filter(acctbal__lt=0, nation__name__startswith="A")
    assert not joins(own.update(mktsegment="X")) and not joins(own.delete())
    assert joins(far.update(mktsegment="X")) and joins(far.delete())
    whole = customers.count()
    assert own.delete().count() == whole - own.count() and far.delete().count() == whole - far.count()
    assert own.update(mktsegment="X").where("mktsegment = 'X'").count() == own.count()
    assert customers.delete().isEmpty() and customers.none().delete().count() == whole
    first = customers.order_by("custkey")[:5]
    assert first.delete().count() == whole - 5
    assert customers.annotate(low=F_("acctbal") * 2).filter(low__lt=0).delete().count() == customers.filter(acctbal__gte=0).count()
