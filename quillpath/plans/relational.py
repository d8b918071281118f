"""Queries of the query algebra over the test tables, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpath.functions.expressions import (
    ArrayAgg, ArraySubquery, Avg, Case, Cast, Coalesce, Collate, Concat, Count, Exists, ExpressionWrapper, Extract, ExtractDay, ExtractHour, ExtractMinute,
    ExtractMonth, ExtractQuarter, ExtractSecond, ExtractWeek, ExtractWeekDay, ExtractYear, F_, FirstValue, Func, Greatest, JSONBAgg, JSONObject, Lag, LastValue,
    Lead, Least, Length, Max, Min, NthValue, OuterRef, Q, Replace, StringAgg, Subquery, Substr, Sum, TruncDate, Value, When, Window,
)
from quillpath.functions.lookups import register_kind, register_lookup
from quillpath.operators.queryset import QuerySet, Source
from quillpath.plans.catalog import Catalog, Field, Model, shop

Objects = Callable[..., QuerySet]
_MADE: dict[str, tuple[Callable[[Objects], Any], str]] = {}


def query(name: str, build: Callable[[Objects], Any], sql: str) -> None:
    _MADE[name] = (build, sql)


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that engines agree on types."""
    return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes))


def source(spark: SparkSession, sf_dir: str) -> Source:
    return Source(spark, shop(), {"default": sf_dir})


def _run(build: Callable[[Objects], Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = build(source(spark, sf_dir).objects)
        return plain(got.dataframe() if isinstance(got, QuerySet) else got)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(build) for name, (build, _) in _MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _MADE.items() if sql}


# ---- sources, writes ---------------------------------------------------------------------------

_CUST = "CAST(c_custkey AS BIGINT) AS custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS acctbal, c_mktsegment AS mktsegment"
query("S11_objects_all", lambda O: O("Customer").all(), f"SELECT {_CUST} FROM customer")
query("S12_none", lambda O: O("Customer").none(), f"SELECT {_CUST} FROM customer WHERE false")
query("S13_raw", lambda O: O("Customer").raw("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > :low GROUP BY 1", {"low": 100.0}), "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
query("S14_using", lambda O: O("Region").using("default"), "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, r_name AS name FROM region")
query("S16_bulk_create_ignore", lambda O: O("Region").bulk_create([{"regionkey": 1, "name": "X"}, {"regionkey": 77, "name": "NEW"}], ignore_conflicts=True), "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, r_name AS name FROM region UNION ALL SELECT 77, 'NEW'")
query("S16_bulk_create_update", lambda O: O("Region").bulk_create([{"regionkey": 1, "name": "X"}, {"regionkey": 77, "name": "NEW"}], update_conflicts=True, update_fields=("name",)), "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS name FROM region UNION ALL SELECT 77, 'NEW'")
query("S17_update", lambda O: O("Customer").filter(acctbal__lt=0).update(acctbal=F_("acctbal") * 2, mktsegment="DEBT"), "SELECT CAST(c_custkey AS BIGINT) AS custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS mktsegment FROM customer")
query("S17_bulk_update", lambda O: O("Nation").bulk_update([{"nationkey": 3, "name": "THREE"}, {"nationkey": 4, "name": None}], ["name"]), "SELECT CAST(n_nationkey AS BIGINT) AS nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE' WHEN n_nationkey = 4 THEN NULL ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
query("S18_delete", lambda O: O("Customer").filter(orders__status="F").delete(), f"SELECT {_CUST} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
query("S19_get_or_create", lambda O: O("Region").get_or_create(regionkey=99, defaults={"name": "LAST"})[0], "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, r_name AS name FROM region UNION ALL SELECT 99, 'LAST'")
query("S19_update_or_create", lambda O: O("Region").update_or_create(regionkey=2, defaults={"name": "TWO"})[0], "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, CASE WHEN r_regionkey = 2 THEN 'TWO' ELSE r_name END AS name FROM region")
query("S21_validate_unique", lambda O: O("LineItem").duplicates("order", "linenumber"), "SELECT CAST(l_orderkey AS BIGINT) AS \"order\", CAST(l_linenumber AS BIGINT) AS linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
query("S22_only_columns", lambda O: O("Customer").defer("mktsegment", "acctbal"), "SELECT CAST(c_custkey AS BIGINT) AS custkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation FROM customer")

# ---- projection ------------------------------------------------------------------------------------

query("P01_values", lambda O: O("Order").values("orderkey", "customer__name", "customer__nation__region__name"), 'SELECT o_orderkey AS orderkey, c_name AS "customer__name", r_name AS "customer__nation__region__name" FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey')
query("P02_values_list", lambda O: O("Customer").values_list("mktsegment", flat=True), "SELECT c_mktsegment AS mktsegment FROM customer")
query("P03_only", lambda O: O("Part").only("name", "size"), "SELECT p_partkey AS partkey, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part")
query("P04_defer", lambda O: O("Supplier").defer("acctbal"), "SELECT s_suppkey AS suppkey, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
query("P05_annotate", lambda O: O("Part").annotate(total=F_("retailprice") * F_("size")).values("partkey", "total"), "SELECT p_partkey AS partkey, p_retailprice * p_size AS total FROM part")
query("P06_alias", lambda O: O("Customer").alias(n=Length("mktsegment")).filter(n__gt=8), f"SELECT {_CUST} FROM customer WHERE length(c_mktsegment) > 8")
query("P07_annotation_propagates", lambda O: O("Customer").annotate(up=F_("acctbal") + 1).filter(acctbal__gt=0).order_by("up").exclude(up__gt=5000), f"SELECT {_CUST}, c_acctbal + 1 AS up FROM customer WHERE c_acctbal > 0 AND NOT (c_acctbal + 1 > 5000)")
query("P08_annotation_redefined", lambda O: O("Region").annotate(x=Value(1)).annotate(x=F_("x") + 4), "SELECT CAST(r_regionkey AS BIGINT) AS regionkey, r_name AS name, CAST(5 AS BIGINT) AS x FROM region")
query("P13_dates", lambda O: O("Order").dates("orderdate", "month"), "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS datefield FROM orders")
query("P13_datetimes", lambda O: O("Event").datetimes("ts", "hour", "DESC"), "SELECT DISTINCT date_trunc('hour', ts) AS datefield FROM events")

# ---- filters ---------------------------------------------------------------------------------------

query("F01_filter_path", lambda O: O("LineItem").filter(order__customer__nation__name__startswith="NATION_1", quantity__gt=30).values("order", "order__customer__name", "order__customer__nation__name", "quantity", "extendedprice"), """SELECT l_orderkey AS "order", c_name AS "order__customer__name", n_name AS "order__customer__nation__name", l_quantity AS quantity, l_extendedprice AS extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' AND l_quantity > 30""")
query("F02_exclude", lambda O: O("Customer").exclude(acctbal__gt=0, mktsegment="BUILDING"), f"SELECT {_CUST} FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING')")
query("F02_exclude_null", lambda O: O("Document").exclude(label__quality=1).values("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
query("F02_exclude_many", lambda O: O("Customer").exclude(orders__status="F", orders__totalprice__gt=100000), f"SELECT {_CUST} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
query("F03_get", lambda O: O("Customer").filter(pk=7), f"SELECT {_CUST} FROM customer WHERE c_custkey = 7")
query("F04_q", lambda O: O("Customer").filter(Q(mktsegment="BUILDING") & ~Q(acctbal__lt=500) | Q(nation__region__name="ASIA")), f"SELECT {_CUST} FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE (c_mktsegment = 'BUILDING' AND NOT c_acctbal < 500) OR r_name = 'ASIA'")
query("F05_f", lambda O: O("LineItem").filter(extendedprice__gt=F_("part__retailprice") * 40).values("order", "linenumber", "extendedprice"), 'SELECT l_orderkey AS "order", CAST(l_linenumber AS BIGINT) AS linenumber, l_extendedprice AS extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > p_retailprice * 40')
query("F06_dict_keys", lambda O: O("Order").filter(**{"customer__mktsegment": "MACHINERY", "status__in": ["F", "O"]}).values("orderkey"), "SELECT o_orderkey AS orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus IN ('F', 'O')")
query("F07_exists", lambda O: O("Order").filter(totalprice__gt=100).values("orderkey").order_by("orderkey")[:1].aggregates(found=Count("*")), "SELECT count(*) AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 100 LIMIT 1)")
query("F08_contains", lambda O: O("Order").filter(totalprice__gt=1000).filter(pk=12).aggregates(found=Count("*")), "SELECT count(*) AS found FROM orders WHERE o_totalprice > 1000 AND o_orderkey = 12")
query("F09_in_bulk", lambda O: O("Part").filter(pk__in=[1, 5, 9, 10_000_000]), "SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, p_retailprice AS retailprice FROM part WHERE p_partkey IN (1, 5, 9)")
query("F10_check_constraint", lambda O: O("Customer").violations(Q(acctbal__gte=0)).values("custkey"), "SELECT c_custkey AS custkey FROM customer WHERE NOT c_acctbal >= 0")
query("F10_unique_condition", lambda O: O("Order").duplicates("customer", "orderdate", condition=Q(status="F")), "SELECT o_custkey AS customer, o_orderdate AS orderdate, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) > 1")
query("F11_filter_many", lambda O: O("Customer").filter(orders__totalprice__gt=450000).values("custkey", "orders__orderkey"), 'SELECT c_custkey AS custkey, o_orderkey AS "orders__orderkey" FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000')


def _kept(name: str, model: str, lookups: dict[str, Any], table: str, key: str, column: str, where: str) -> None:
    query(name, lambda O: O(model).filter(**lookups).values(key), f"SELECT CAST({column} AS BIGINT) AS {key} FROM {table} WHERE {where}")


for _id, _lookup, _value, _where in (
    ("K01", "exact", "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("K02", "iexact", "bUilding", "lower(c_mktsegment) = 'building'"),
    ("K03", "contains", "UIL", "contains(c_mktsegment, 'UIL')"),
    ("K04", "icontains", "uiL", "contains(lower(c_mktsegment), 'uil')"),
    ("K05", "in", ["BUILDING", "MACHINERY"], "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("K10", "startswith", "B", "starts_with(c_mktsegment, 'B')"),
    ("K11", "istartswith", "b", "starts_with(lower(c_mktsegment), 'b')"),
    ("K12", "endswith", "Y", "ends_with(c_mktsegment, 'Y')"),
    ("K13", "iendswith", "y", "ends_with(lower(c_mktsegment), 'y')"),
    ("K16", "regex", "^[BM].*G$|RY", "regexp_matches(c_mktsegment, '^[BM].*G$|RY')"),
    ("K17", "iregex", "^b.*g$", "regexp_matches(c_mktsegment, '(?i)^b.*g$')"),
):
    _kept(f"{_id}_{_lookup}", "Customer", {f"mktsegment__{_lookup}": _value}, "customer", "custkey", "c_custkey", _where)
for _id, _lookup, _value, _where in (
    ("K06", "gt", 4000, "c_acctbal > 4000"), ("K07", "gte", 4000, "c_acctbal >= 4000"), ("K08", "lt", 0, "c_acctbal < 0"), ("K09", "lte", 0, "c_acctbal <= 0"),
    ("K14", "range", (0, 1000), "c_acctbal BETWEEN 0 AND 1000"), ("K15", "isnull", False, "c_acctbal IS NOT NULL"),
):
    _kept(f"{_id}_{_lookup}", "Customer", {f"acctbal__{_lookup}": _value}, "customer", "custkey", "c_custkey", _where)
query("K05_in_query", lambda O: O("Order").filter(customer__in=O("Customer").filter(acctbal__gt=9000)).values("orderkey"), "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
query("K15_isnull_relation", lambda O: O("Document").filter(label__isnull=True).values("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
import datetime as _dt  # noqa: E402

for _id, _part, _value, _sql in (
    ("K18", "date", _dt.date(2024, 1, 3), "CAST(ts AS DATE) = DATE '2024-01-03'"), ("K19", "year", 2024, "year(ts) = 2024"), ("K20", "month", 1, "month(ts) = 1"), ("K21", "day", 3, "day(ts) = 3"),
    ("K22", "week", 2, "week(ts) = 2"), ("K23", "week_day", 3, "dayofweek(ts) + 1 = 3"), ("K24", "quarter", 1, "quarter(ts) = 1"), ("K25", "time", "10:00:00.000000", "strftime(ts, '%H:%M:%S.%f') = '10:00:00.000000'"),
    ("K26", "hour", 10, "hour(ts) = 10"), ("K27", "minute", 30, "minute(ts) = 30"), ("K28", "second", 15, "second(ts) = 15"), ("K29", "iso_year", 2024, "isoyear(ts) = 2024"), ("K30", "iso_week_day", 2, "isodow(ts) = 2"),
):
    _kept(f"{_id}_{_part}", "Event", {f"ts__{_part}": _value}, "events", "event_id", "event_id", _sql)
for _id, _lookup, _value, _where in (
    ("K31", "contains", {"k": 42}, "json_extract_string(props, '$.k') = '42'"), ("K32", "contained_by", {"k": 7, "z": 1}, "json_extract_string(props, '$.k') = '7'"),
    ("K33", "has_key", "k", "list_contains(json_keys(props), 'k')"), ("K34", "has_keys", ["k", "none"], "list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'none')"),
    ("K35", "has_any_keys", ["k", "none"], "list_contains(json_keys(props), 'k') OR list_contains(json_keys(props), 'none')"),
):
    _kept(f"{_id}_json_{_lookup}", "Event", {f"props__{_lookup}": _value}, "events", "event_id", "event_id", _where)
register_lookup("above_share", lambda c, v: c > F.lit(1000.0) * v, "FloatField")
_kept("K36_custom_lookup", "Customer", {"acctbal__above_share": 5}, "customer", "custkey", "c_custkey", "c_acctbal > 5000")
_kept("R06_transform_then_lookup", "Order", {"orderdate__year__gte": 1996, "customer__name__lower__endswith": "7"}, "orders JOIN customer ON c_custkey = o_custkey", "orderkey", "o_orderkey", "year(o_orderdate) >= 1996 AND ends_with(lower(c_name), '7')")
query("R08_virtual_path", lambda O: O("Customer").annotate(seg=F_("mktsegment")).annotate(n=Length("seg")).filter(n__gte=9).values("custkey", "n"), "SELECT c_custkey AS custkey, length(c_mktsegment) AS n FROM customer WHERE length(c_mktsegment) >= 9")

# ---- joins -----------------------------------------------------------------------------------------

query("J01_forward_key", lambda O: O("Nation").values("name", "region__name"), 'SELECT n_name AS name, r_name AS "region__name" FROM nation JOIN region ON r_regionkey = n_regionkey')
query("J02_forward_one", lambda O: O("Label").values("document__lang", "quality").annotate(n=Count("toxic")), 'SELECT lang AS "document__lang", CAST(quality AS BIGINT) AS quality, count(toxic) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2')
query("J03_reverse_key", lambda O: O("Nation").values("name", "customers__name"), 'SELECT n_name AS name, c_name AS "customers__name" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey')
query("J04_reverse_one", lambda O: O("Document").values("doc_id", "label__quality"), 'SELECT doc_id, CAST(quality AS BIGINT) AS "label__quality" FROM documents LEFT JOIN labels USING (doc_id)')
query("J05_many_to_many", lambda O: O("Part").filter(suppliers__nation__name="NATION_3").values("partkey", "suppliers__name"), 'SELECT DISTINCT p_partkey AS partkey, s_name AS "suppliers__name" FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = \'NATION_3\'')


def _mentors(O: Objects) -> QuerySet:
    """Customers with the customer of half their key as mentor: a relation of a table to itself."""
    spark = O("Customer").source.spark
    rows = O("Customer").df.select(F.col("custkey").alias("id"), F.col("name"), F.when(F.col("custkey") > 0, F.floor(F.col("custkey") / 2)).alias("mentor_id"))
    model = Model("crew.Author", "author", "id", (Field("id", "BigAutoField", "id"), Field("name", "CharField", "name"), Field("mentor", "ForeignKey", "mentor_id", "crew.Author", "mentees")))
    return Source(spark, Catalog({model.label: model}), {}, {"author": rows}).objects("Author").values("name", "mentor__name", "mentor__mentor__name")


query("J06_self_relation", _mentors, 'SELECT a.c_name AS name, b.c_name AS "mentor__name", c.c_name AS "mentor__mentor__name" FROM customer a LEFT JOIN customer b ON a.c_custkey > 0 AND b.c_custkey = a.c_custkey // 2 LEFT JOIN customer c ON b.c_custkey > 0 AND c.c_custkey = b.c_custkey // 2')
query("J07_shared_prefix", lambda O: O("LineItem").filter(order__customer__mktsegment="BUILDING", order__status="F", order__customer__nation__region__name="EUROPE").values("order", "linenumber", "quantity"), """SELECT l_orderkey AS "order", CAST(l_linenumber AS BIGINT) AS linenumber, l_quantity AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND r_name = 'EUROPE'""")
query("J08_select_related", lambda O: O("Supplier").select_related("nation__region").only("name"), 'SELECT s_suppkey AS suppkey, s_name AS name, CAST(n_nationkey AS BIGINT) AS "nation__nationkey", n_name AS "nation__name", CAST(n_regionkey AS BIGINT) AS "nation__region", CAST(r_regionkey AS BIGINT) AS "nation__region__regionkey", r_name AS "nation__region__name" FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey')
query("J09_prefetch_related", lambda O: O("Nation").prefetch_related("customers").dataframe().select("name", F.size("customers_rows").alias("n"), F.transform("customers_rows", lambda r: r["custkey"]).alias("keys")), "SELECT n_name AS name, count(c_custkey) AS n, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []) AS keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
query("J10_subquery", lambda O: O("Customer").annotate(latest=Subquery(O("Order").filter(customer=OuterRef("pk")).order_by("-orderdate", "-orderkey").values("totalprice")[:1])).values("custkey", "latest"), "SELECT c_custkey AS custkey, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer")
query("J11_exists", lambda O: O("Customer").filter(Exists(O("Order").filter(customer=OuterRef("pk"), totalprice__gt=490000))), f"SELECT {_CUST} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
query("J11_not_exists", lambda O: O("Customer").annotate(calm=~Exists(O("Event").filter(user=OuterRef("custkey"), value__gt=50))).values("custkey", "calm"), "SELECT c_custkey AS custkey, NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 50) AS calm FROM customer")
query("J12_array_subquery", lambda O: O("Customer").annotate(ks=ArraySubquery(O("Order").filter(customer=OuterRef("pk"), status="F").values("orderkey"))).values("custkey", "ks"), "SELECT c_custkey AS custkey, coalesce((SELECT list(o_orderkey ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), []) AS ks FROM customer")

# ---- aggregates ------------------------------------------------------------------------------------

query("A01_aggregate", lambda O: O("Order").aggregates(n=Count("*"), low=Min("totalprice"), high=Max("orderdate")), "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_orderdate) AS high FROM orders")
query("A02_annotate_count", lambda O: O("Customer").annotate(n=Count("orders")).values("custkey", "n"), "SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
query("A02_two_relations", lambda O: O("Customer").annotate(n=Count("orders"), m=Count("events"), f=Count("orders", filter=Q(orders__status="F"))).values("custkey", "n", "m", "f"), "SELECT c_custkey AS custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS m, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS f FROM customer")
query("A03_group_by", lambda O: O("Order").values("customer__nation__name", "status").annotate(n=Count("orderkey"), top=Max("totalprice")), 'SELECT n_name AS "customer__nation__name", o_orderstatus AS status, count(o_orderkey) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2')
for _id, _name, _agg, _sql in (
    ("A04", "count_distinct", Count("customer", distinct=True), "count(DISTINCT o_custkey)"), ("A05", "sum", Cast(Sum("totalprice"), "decimal(30,2)"), "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(30,2))"),
    ("A07", "min", Min("totalprice"), "min(o_totalprice)"), ("A08", "max", Max("totalprice"), "max(o_totalprice)"),
):
    if _id != "A05":
        query(f"{_id}_{_name}", lambda O, a=_agg: O("Order").values("status").annotate(v=a), f"SELECT o_orderstatus AS status, {_sql} AS v FROM orders GROUP BY 1")
query("A05_sum", lambda O: O("LineItem").values("returnflag").annotate(v=Sum("linenumber")), "SELECT l_returnflag AS returnflag, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
query("A06_avg", lambda O: O("LineItem").values("returnflag").annotate(v=Avg("linenumber")).dataframe().withColumn("v", F.round("v", 6)), "SELECT l_returnflag AS returnflag, round(avg(l_linenumber), 6) AS v FROM lineitem GROUP BY 1")
query("A09_array_agg", lambda O: O("Nation").values("region__name").annotate(v=ArrayAgg("name")), 'SELECT r_name AS "region__name", list_sort(list(n_name)) AS v FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1')
query("A10_jsonb_agg", lambda O: O("Nation").values("region__name").annotate(v=JSONBAgg("nationkey")), 'SELECT r_name AS "region__name", CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS v FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1')
query("A11_string_agg", lambda O: O("Nation").values("region__name").annotate(v=StringAgg("name", "; ")), "SELECT r_name AS \"region__name\", string_agg(n_name, '; ' ORDER BY n_name) AS v FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
query("A12_count", lambda O: O("LineItem").filter(returnflag="R").aggregates(n=Count("*")), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
query("A13_distinct", lambda O: O("Order").values("status", "priority").distinct(), "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
query("A13_distinct_on", lambda O: O("Order").order_by("customer", "-totalprice", "orderkey").distinct("customer").values("customer", "orderkey"), "SELECT o_custkey AS customer, o_orderkey AS orderkey FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey)")
query("A14_having", lambda O: O("Order").values("customer").annotate(n=Count("orderkey")).filter(n__gt=12), "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")

# ---- windows (order total) ---------------------------------------------------------------------------

for _id, _name, _f, _sql in (
    ("W02", "lag", Lag("totalprice"), "lag(o_totalprice)"), ("W03", "lead", Lead("totalprice", 2), "lead(o_totalprice, 2)"), ("W04", "first_value", FirstValue("totalprice"), "first_value(o_totalprice)"),
    ("W05", "last_value", LastValue("orderkey"), "last_value(o_orderkey)"), ("W06", "nth_value", NthValue("orderkey", 2), "nth_value(o_orderkey, 2)"), ("W07", "count_over", Count("orderkey"), "count(o_orderkey)"),
):
    query(f"{_id}_{_name}", lambda O, f=_f: O("Order").annotate(v=Window(f, partition_by="customer", order_by=[F_("orderdate").asc(), "orderkey"])).values("orderkey", "v"), f"SELECT o_orderkey AS orderkey, {_sql} OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders")
query("W01_window", lambda O: O("Order").annotate(v=Window(Max("totalprice"), partition_by=["customer", "status"])).values("orderkey", "v"), "SELECT o_orderkey AS orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS v FROM orders")
query("W08_direction", lambda O: O("Order").annotate(v=Window(Lag("orderkey"), partition_by="customer", order_by=[F_("orderdate").desc(), F_("orderkey").desc()])).values("orderkey", "v"), "SELECT o_orderkey AS orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS v FROM orders")

# ---- scalar expressions and transforms ---------------------------------------------------------------

for _id, _name, _e, _sql in (
    ("E01", "value", Value("x"), "'x'"), ("E02", "f", F_("customer__nation__name"), "n_name"), ("E03", "expression_wrapper", ExpressionWrapper(F_("totalprice") * 100, "bigint"), "CAST(trunc(o_totalprice * 100) AS BIGINT)"),
    ("E04", "case", Case(When(status="F", then=Value("done")), When(Q(totalprice__gt=300000) | Q(priority__startswith="1"), then=Value("big")), default=Value("small")), "CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 300000 OR starts_with(o_orderpriority, '1') THEN 'big' ELSE 'small' END"),
    ("E05", "when", Case(When(Q(customer__acctbal__lt=0), then=F_("customer__acctbal"))), "CASE WHEN c_acctbal < 0 THEN c_acctbal END"),
    ("E06", "cast", Cast("orderkey", "string"), "CAST(o_orderkey AS VARCHAR)"), ("E07", "coalesce", Coalesce(Case(When(status="F", then=F_("priority"))), "status"), "coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus)"),
    ("E08", "func", Func("priority", function="upper"), "upper(o_orderpriority)"), ("E09", "concat", Concat("status", Value("-"), Case(When(status="F", then=F_("priority")))), "o_orderstatus || '-' || coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '')"),
    ("E10", "greatest", Greatest("totalprice", "customer__acctbal"), "greatest(o_totalprice, c_acctbal)"), ("E11", "least", Least("totalprice", "customer__acctbal"), "least(o_totalprice, c_acctbal)"),
    ("E12", "length", Length("priority"), "length(o_orderpriority)"), ("E13", "replace", Replace("priority", "-", "_"), "replace(o_orderpriority, '-', '_')"), ("E14", "collate", Cast(Func(Collate("status", "C"), function="lower"), "string"), "lower(o_orderstatus)"),
    ("E15", "substr", Substr("priority", 3, 4), "substr(o_orderpriority, 3, 4)"), ("E16", "extract", Extract("orderdate", "DOY"), "dayofyear(o_orderdate)"), ("E17", "extract_year", ExtractYear("orderdate"), "year(o_orderdate)"),
    ("E18", "extract_day", ExtractDay("orderdate"), "day(o_orderdate)"), ("E19", "extract_month", ExtractMonth("orderdate"), "month(o_orderdate)"), ("E20", "extract_week", ExtractWeek("orderdate"), "week(o_orderdate)"),
    ("E21", "extract_week_day", ExtractWeekDay("orderdate"), "dayofweek(o_orderdate) + 1"), ("E22", "extract_quarter", ExtractQuarter("orderdate"), "quarter(o_orderdate)"), ("E23", "extract_hour", ExtractHour("orderdate"), "hour(o_orderdate)"),
    ("E24", "extract_minute", ExtractMinute("orderdate"), "minute(o_orderdate)"), ("E25", "extract_second", ExtractSecond("orderdate"), "second(o_orderdate)"), ("E26", "trunc_date", TruncDate("orderdate"), "CAST(o_orderdate AS DATE)"),
    ("E27", "json_object", JSONObject(s="status", k="orderkey"), "CAST(json_object('s', o_orderstatus, 'k', o_orderkey) AS VARCHAR)"), ("P05", "arithmetic", (F_("totalprice") + 1) / 2 - F_("orderkey"), "(o_totalprice + 1) / 2 - o_orderkey"),
):
    query(f"{_id}_{_name}", lambda O, e=_e: O("Order").annotate(v=e).values("orderkey", "v"), f"SELECT o_orderkey AS orderkey, {_sql} AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
query("E28_outer_ref", lambda O: O("Nation").annotate(top=Subquery(O("Customer").filter(nation=OuterRef("nationkey")).order_by("-acctbal", "custkey").values("name")[:1])).values("name", "top"), "SELECT n_name AS name, (SELECT c_name FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS top FROM nation")
for _id, _t, _sql in (("T01", "lower", "lower(p_name)"), ("T02", "upper", "upper(p_name)"), ("T03", "length", "length(p_name)"), ("T04", "trim", "trim(p_name)"), ("T05", "ltrim", "ltrim(p_name)"), ("T06", "rtrim", "rtrim(p_name)")):
    query(f"{_id}_{_t}", lambda O, t=_t: O("Part").annotate(v=F_(f"name__{t}")).values("partkey", "v"), f"SELECT p_partkey AS partkey, {_sql} AS v FROM part")
for _id, _t, _sql in (
    ("T07", "year", "year(ts)"), ("T08", "month", "month(ts)"), ("T09", "day", "day(ts)"), ("T10", "hour", "hour(ts)"), ("T11", "minute", "minute(ts)"), ("T12", "second", "second(ts)"), ("T13", "date", "CAST(ts AS DATE)"),
    ("T14", "time", "strftime(ts, '%H:%M:%S.%f')"), ("T15", "week", "week(ts)"), ("T16", "week_day", "dayofweek(ts) + 1"), ("T17", "quarter", "quarter(ts)"), ("T18", "iso_year", "isoyear(ts)"), ("T19", "iso_week_day", "isodow(ts)"),
):
    query(f"{_id}_{_t}", lambda O, t=_t: O("Event").annotate(v=F_(f"ts__{t}")).values("event_id", "v"), f"SELECT event_id, {_sql} AS v FROM events")
query("T20_json_key", lambda O: O("Event").annotate(v=F_("props__k")).values("event_id", "v"), "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")

# ---- order, slices, sets -------------------------------------------------------------------------------

query("O01_order_by", lambda O: O("Customer").order_by("-acctbal", "custkey")[:20].values("custkey", "acctbal"), "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
query("O02_reverse", lambda O: O("Customer").order_by("-acctbal", "custkey").reverse()[:20].values("custkey"), "SELECT c_custkey AS custkey FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 20")
query("O03_last", lambda O: O("Order").order_by("orderdate", "orderkey").reverse()[:1].values("orderkey"), "SELECT o_orderkey AS orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
query("O04_latest", lambda O: O("Event").latest("ts", "event_id").values("event_id"), "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
query("O04_earliest", lambda O: O("Event").earliest("ts", "event_id").values("event_id"), "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1")
query("O05_slice", lambda O: O("Part").order_by("-retailprice", "partkey")[10:25].values("partkey"), "SELECT p_partkey AS partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 10")
query("U01_union", lambda O: O("Customer").values_list("nation__name").union(O("Supplier").values_list("nation__name")), 'SELECT n_name AS "nation__name" FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey')
query("U01_union_all", lambda O: O("Region").values("name").union(O("Nation").values("name"), all=True), "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
query("U02_intersection", lambda O: O("Customer").values("nation").intersection(O("Supplier").values("nation")), "SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("U03_difference", lambda O: O("Customer").values("custkey").difference(O("Order").filter(totalprice__gt=400000).values("customer")), "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")

# ---- projects' own code ------------------------------------------------------------------------------

register_kind("SegmentField", "CharField")


class Rich(QuerySet):
    """A query class with methods of its own."""

    def rich(self, least: float) -> Rich:
        return self.filter(acctbal__gt=least)


class Building(QuerySet):
    """A query class whose rows are a part of the table."""

    def get_queryset(self, df: DataFrame) -> DataFrame:
        return df.where("mktsegment = 'BUILDING'")


def _segments(O: Objects) -> QuerySet:
    model = Model("own.Buyer", "customer", "id", (Field("id", "BigAutoField", "c_custkey"), Field("segment", "SegmentField", "c_mktsegment")))
    s = O("Customer").source
    return Source(s.spark, Catalog({model.label: model}), s.folders).objects("Buyer").filter(segment__icontains="build")


query("X02_custom_kind", _segments, "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE contains(lower(c_mktsegment), 'build')")
query("X03_custom_method", lambda O: O("Customer", Rich).rich(9000).values("custkey"), "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000")
query("X05_func", lambda O: O("Part").annotate(v=Func("name", Value(" "), Value("+"), function="replace")).values("partkey", "v"), "SELECT p_partkey AS partkey, replace(p_name, ' ', '+') AS v FROM part")
query("X06_extra", lambda O: O("Customer").extra(select={"double": "acctbal * 2"}, where=["acctbal > 9000"]).values("custkey", "double"), 'SELECT c_custkey AS custkey, c_acctbal * 2 AS "double" FROM customer WHERE c_acctbal > 9000')
query("X09_get_queryset", lambda O: O("Customer", Building).values("custkey"), "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
