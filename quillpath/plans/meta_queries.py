"""Queries of the metadata layer: over a small project of ours, over the catalog, and over the test tables.

Results over the project and the catalog do not depend on the test tables; their SQL states the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpath.plans import metadata, search, surface, telemetry
from quillpath.plans.catalog import shop
from quillpath.plans.relational import plain
from quillpath.sources import source_files, usages
from quillpath.sources.modules import read_modules
from quillpath.streaming import incremental

PROJECT = {
    "farm/__init__.py": "from .api import *\nfrom .base import Stamped as Dated\n",
    "farm/api.py": "from .animals import Horse, Stable\nfrom . import base as kit\n__all__ = ['Horse', 'Stable']\n_hidden = 1\n",
    "farm/base.py": "from django.db import models\nKey = models.ForeignKey\nclass Stamped(models.Model):\n    made_at = models.DateTimeField()\n    label = models.CharField(max_length=9)\n    class Meta:\n        abstract = True\nclass Ranked(models.Model):\n    rank = models.IntegerField()\n    label = models.TextField()\n    class Meta:\n        abstract = True\n",
    "farm/animals.py": "from django.db import models\nfrom .base import Stamped, Ranked, Key\nimport farm.base as fb\nclass Stable(Stamped):\n    name = models.CharField(max_length=50)\n    def free(self) -> int:\n        return 1\nclass Horse(Stamped, Ranked):\n    home = Key(Stable, related_name='horses', on_delete=models.CASCADE)\n    dam = models.ForeignKey('self', null=True, related_name='foals', on_delete=models.CASCADE)\n    shoes = models.ManyToManyField('store.Shoe', related_name='+')\n    @property\n    def age(self) -> int:\n        return 3\nclass Foal(Horse):\n    weight = models.FloatField()\nclass Pass(fb.Ranked):\n    horse = models.OneToOneField('Horse', on_delete=models.CASCADE)\n",
    "farm/broken.py": "class Oops(:\n",
    "store/__init__.py": "",
    "store/models.py": "from farm import Horse\nfrom django.db import models\nclass Shoe(models.Model):\n    size = models.IntegerField()\n    worn_by = models.ForeignKey(Horse, related_query_name='worn', on_delete=models.CASCADE)\nclass helper:\n    pass\n",
    "store/loop_a.py": "from .loop_b import ping\nfrom .loop_b import *\n",
    "store/loop_b.py": "from .loop_a import *\ndef pong():\n    pass\n",
}


def project_files(spark: SparkSession) -> DataFrame:
    rows = [(p, len(t.encode()), 1_700_000_000_000_000 + i, t) for i, (p, t) in enumerate(PROJECT.items())]
    return source_files.fingerprinted(spark.createDataFrame(rows, "path string, size long, mtime_us long, text string"))


_BUILT: dict[str, metadata.Metadata] = {}


def project(spark: SparkSession) -> metadata.Metadata:
    """The project's tables, built once for each application; they lie in its checkpoints."""
    key = spark.sparkContext.applicationId
    if key not in _BUILT:
        _BUILT[key] = metadata.build(read_modules(project_files(spark)))
    return _BUILT[key]


_MADE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str = "") -> None:
    _MADE[name] = (build, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plain(build(spark, sf_dir))

    return {n: run(b) for n, (b, _) in _MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _MADE.items() if s}


def _values(columns: str, *rows: tuple) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CATALOG = shop()
_FIELD_ROWS = [(label, f.name, f.kind, f.direction or None, f.target or None) for label, fs in _CATALOG.members.items() for f in fs.values()]
#: The catalog's fields as SQL, for oracles that walk them.
_FIELDS_SQL = f"fields AS ({_values('model, name, kind, direction, target', *_FIELD_ROWS)})"
_EDGES_SQL = "edges AS (SELECT DISTINCT model AS source, target, direction FROM fields WHERE target IS NOT NULL)"


def _fields(spark: SparkSession) -> DataFrame:
    return metadata.catalog_tables(spark, _CATALOG)[1]


def _models(spark: SparkSession) -> DataFrame:
    return metadata.catalog_tables(spark, _CATALOG)[0]


# ---- files and modules -------------------------------------------------------------------------------

import hashlib as _hashlib  # noqa: E402

_PRINTS = [(p, _hashlib.sha256(f"{p}\0{len(t.encode())}:{1_700_000_000_000_000 + i}".encode()).hexdigest()) for i, (p, t) in enumerate(PROJECT.items())]
query("S03_file_fingerprint", lambda s, d: project_files(s).select("path", "fingerprint"), _values("path, fingerprint", *_PRINTS))


def _directory(prefix: str) -> str:
    inside = {p: f for p, f in _PRINTS if p.startswith(prefix) and "/" not in p[len(prefix) :]}
    for sub in {prefix + p[len(prefix) :].split("/")[0] for p, _ in _PRINTS if p.startswith(prefix) and "/" in p[len(prefix) :]}:
        inside[sub] = _directory(f"{sub}/")
    return _hashlib.sha256("\n".join(sorted(f"{p}\0{f}" for p, f in inside.items())).encode()).hexdigest()


query("S04_directory_fingerprints", lambda s, d: source_files.directory_fingerprints(project_files(s)), _values("path, fingerprint", ("", _directory("")), ("farm", _directory("farm/")), ("store", _directory("store/"))))
query("S07_parse_modules", lambda s, d: read_modules(project_files(s)).select("module", "is_package", F.size("symbols").alias("symbols"), F.size("imports").alias("imports"), F.size("classes").alias("classes"), F.size("fields").alias("fields"), F.col("error").isNotNull().alias("failed")),
      _values("module, is_package, symbols, imports, classes, fields, failed", ("farm", True, 0, 2, 0, 0, False), ("farm.api", False, 1, 3, 0, 0, False), ("farm.base", False, 3, 1, 2, 4, False), ("farm.animals", False, 4, 5, 4, 6, False), ("farm.broken", False, 0, 0, 0, 0, True), ("store", True, 0, 0, 0, 0, False), ("store.models", False, 2, 2, 2, 2, False), ("store.loop_a", False, 0, 2, 0, 0, False), ("store.loop_b", False, 1, 1, 0, 0, False)))
query("G01_relative_imports", lambda s, d: read_modules(project_files(s)).select("module", F.explode("imports").alias("i")).select("module", "i.source", "i.symbol").where("startswith(module, 'farm') and startswith(source, 'farm')"),
      _values("module, source, symbol", ("farm", "farm.api", ""), ("farm", "farm.base", "Stamped"), ("farm.api", "farm.animals", "Horse"), ("farm.api", "farm.animals", "Stable"), ("farm.api", "farm", "base"), ("farm.animals", "farm.base", "Stamped"), ("farm.animals", "farm.base", "Ranked"), ("farm.animals", "farm.base", "Key"), ("farm.animals", "farm.base", "")))
query("G02_exports", lambda s, d: project(s).exports.select("module", "symbol", "origin_module", F.array_join("via", ">").alias("via")).where("module in ('farm', 'store.loop_a', 'store.loop_b')"),
      _values("module, symbol, origin_module, via", ("farm", "Horse", "farm.animals", "farm.api>farm.animals"), ("farm", "Stable", "farm.animals", "farm.api>farm.animals"), ("farm", "Dated", "farm.base", "farm.base"), ("store.loop_a", "pong", "store.loop_b", "store.loop_b"), ("store.loop_b", "pong", "store.loop_b", "")))
query("G03_export_origin", lambda s, d: project(s).exports.where("symbol = 'Horse'").select("module", "origin_module", "origin_symbol"), _values("module, origin_module, origin_symbol", ("farm.animals", "farm.animals", "Horse"), ("farm.api", "farm.animals", "Horse"), ("farm", "farm.animals", "Horse"), ("store.models", "farm.animals", "Horse")))
query("G04_models", lambda s, d: project(s).models.select("label", "module", "is_abstract"), _values("label, module, is_abstract", ("farm.Stamped", "farm.base", True), ("farm.Ranked", "farm.base", True), ("farm.Stable", "farm.animals", False), ("farm.Horse", "farm.animals", False), ("farm.Foal", "farm.animals", False), ("farm.Pass", "farm.animals", False), ("store.Shoe", "store.models", False)))
query("G05_inherited_fields", lambda s, d: project(s).fields.where("model = 'farm.Foal' and direction is distinct from 'reverse'").select("name", "kind", "provenance", "target"),
      _values("name, kind, provenance, target", ("weight", "FloatField", "declared", None), ("made_at", "DateTimeField", "inherited", None), ("label", "CharField", "inherited", None), ("rank", "IntegerField", "inherited", None), ("home", "ForeignKey", "inherited", "farm.Stable"), ("dam", "ForeignKey", "inherited", "farm.Horse"), ("shoes", "ManyToManyField", "inherited", "store.Shoe")))
query("G06_reverse_relations", lambda s, d: project(s).fields.where("direction = 'reverse' and model <> 'farm.Foal'").select("model", "name", "kind", "target", "provenance"),
      _values("model, name, kind, target, provenance", ("farm.Stable", "horses", "reverse_ForeignKey", "farm.Horse", "reverse"), ("farm.Horse", "foals", "reverse_ForeignKey", "farm.Horse", "reverse"), ("farm.Horse", "pass", "reverse_OneToOneField", "farm.Pass", "reverse"), ("farm.Horse", "shoe_set", "reverse_ForeignKey", "store.Shoe", "reverse"), ("farm.Horse", "worn", "reverse_ForeignKey", "store.Shoe", "related_query_alias")))
query("A18_statistics", lambda s, d: metadata.statistics(read_modules(project_files(s)), project(s).models), _values("files, packages, with_all, star_imports, imports, errors, models, abstract_models", (9, 2, 1, 3, 16, 1, 7, 2)))
query("D09_health", lambda s, d: telemetry.health(metadata.statistics(read_modules(project_files(s)), project(s).models)).select("files", "errors", "phase"), _values("files, errors, phase", (9, 1, "degraded")))

# ---- graph over the catalog ----------------------------------------------------------------------------

query("A15_edges", lambda s, d: metadata.edges(_fields(s)), f"WITH {_FIELDS_SQL} SELECT model AS source, target, direction, list_sort(list(DISTINCT name)) AS field_names, list_sort(list(DISTINCT kind)) AS field_kinds FROM fields WHERE target IS NOT NULL GROUP BY 1, 2, 3")
query("A16_kinds_of_lookups", lambda s, d: search.kinds_of_lookups(search.lookup_table(s)).select("lookup", F.size("kinds").alias("n")), f"SELECT lookup, count(DISTINCT kind) AS n FROM ({_values('kind, lookup', *[(k, n) for k, ns in search.LOOKUPS.items() for n in ns])}) GROUP BY 1")
query("A17_object_names", lambda s, d: metadata.object_names(_models(s)), _values("name, label, n", *[(m.name, label, 1) for label, m in _CATALOG.models.items()]))
query("Z07_nodes", lambda s, d: metadata.nodes(_fields(s)).select("model", F.array_join("relation_names", ",").alias("relations"), F.array_join("reverse_names", ",").alias("reverses")), f"WITH {_FIELDS_SQL} SELECT model, coalesce(string_agg(name, ',' ORDER BY name) FILTER (direction = 'forward'), '') AS relations, coalesce(string_agg(name, ',' ORDER BY name) FILTER (direction = 'reverse'), '') AS reverses FROM fields GROUP BY 1")
query("G11_reachable", lambda s, d: metadata.reachable(metadata.edges(_fields(s)), "shop.LineItem"), f"WITH RECURSIVE {_FIELDS_SQL}, {_EDGES_SQL}, r(node, level) AS (SELECT 'shop.LineItem', 0 UNION SELECT e.target, r.level + 1 FROM r JOIN edges e ON e.source = r.node WHERE r.level < 8) SELECT node, min(level) AS level FROM r GROUP BY 1")
query("G11_reachable_forward", lambda s, d: metadata.reachable(metadata.edges(_fields(s)), "shop.LineItem", False), f"WITH RECURSIVE {_FIELDS_SQL}, {_EDGES_SQL}, r(node, level) AS (SELECT 'shop.LineItem', 0 UNION SELECT e.target, r.level + 1 FROM r JOIN edges e ON e.source = r.node AND e.direction = 'forward' WHERE r.level < 8) SELECT node, min(level) AS level FROM r GROUP BY 1")


def _versions(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    old = _models(s).select("label", F.col("line").cast("string").alias("fingerprint"))
    new = old.where("label <> 'shop.Page'").withColumn("fingerprint", F.when(F.col("label") == "shop.Part", "x").otherwise(F.col("fingerprint"))).unionByName(s.createDataFrame([("shop.New", "1")], "label string, fingerprint string"))
    return old, new


query("U04_label_changes", lambda s, d: source_files.changes(*_versions(s), key="label"), _values("label, change", ("shop.Page", "removed"), ("shop.Part", "changed"), ("shop.New", "added")))
query("J16_overlay", lambda s, d: metadata.overlay(_fields(s), s.createDataFrame([("shop.Part", "name", "TextField", False, None), ("shop.Part", "extra", "JSONField", False, None), ("shop.Part", "odd+", "JSONField", False, None)], "model string, name string, kind string, is_relation boolean, target string")).where("model = 'shop.Part' and name in ('name', 'extra', 'size', 'odd+')").select("name", "kind", "provenance"), _values("name, kind, provenance", ("name", "TextField", "runtime"), ("extra", "JSONField", "runtime"), ("size", "IntegerField", "declared")))

# ---- surface -----------------------------------------------------------------------------------------------

query("P09_members", lambda s, d: surface.members(_models(s), _fields(s)).groupBy("receiver").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models")), _values("receiver, n, models", *[(r, len(_CATALOG.models) * len(b) + (sum(len([f for f in fs.values() if f.source != "related_query_alias"]) for fs in _CATALOG.members.values()) if r == "instance" else 0), len(_CATALOG.models)) for r, b in surface.BUILTINS.items()]))
query("P10_instance_surface", lambda s, d: surface.members(_models(s), _fields(s)).where("model = 'shop.Nation' and receiver = 'instance' and member_kind <> 'builtin_method'").select("name", "return_kind", "return_model", "member_kind"), _values("name, return_kind, return_model, member_kind", ("nationkey", "scalar", None, "field"), ("name", "scalar", None, "field"), ("pk", "scalar", None, "field"), ("region_id", "scalar", None, "field"), ("region", "instance", "shop.Region", "relation"), ("customers", "related_manager", "shop.Customer", "reverse_relation"), ("suppliers", "related_manager", "shop.Supplier", "reverse_relation")))
query("P11_manager_surface", lambda s, d: surface.members(_models(s), _fields(s)).where("model = 'shop.Nation' and receiver = 'manager' and return_kind = 'queryset'").select("name", "return_model"), _values("name, return_model", *[(n, "shop.Nation") for n, k in surface.BUILTINS["manager"].items() if k == "queryset"]))
query("Z18_project_methods", lambda s, d: surface.project_methods(project(s).modules, project(s).models), _values("model, receiver, name, return_kind", ("farm.Stable", "instance", "free", "scalar"), ("farm.Horse", "instance", "age", "scalar")))
query("R12_member_chain", lambda s, d: surface.chain(surface.members(_models(s), _fields(s)), s.createDataFrame([(1, "shop.Order", "model_class", ["objects", "filter", "first", "customer", "nation"]), (2, "shop.Nation", "instance", ["customers", "all", "nope"]), (3, "shop.Part", "instance", ["size"])], "id int, model string, receiver string, names array<string>")), _values("id, model, receiver", (1, "shop.Nation", "instance"), (2, None, None), (3, None, "scalar")))
query("G17_hydrated", lambda s, d: surface.hydrated(surface.members(_models(s), _fields(s))).where("model = 'shop.Order'").select("name", "kind", "direction", "target"), f"WITH {_FIELDS_SQL} SELECT name, kind, direction, target FROM fields WHERE model = 'shop.Order'")

# ---- search, completion, validation ---------------------------------------------------------------------------

query("C01_completions", lambda s, d: search.completions(_fields(s), "shop.Order", "customer__na", "filter").select("name", "group", "depth"), _values('name, "group", depth', ("name", 0, 0), ("nation", 0, 0), ("nation_id", 0, 0), *[(f"name__{x}", 2, 1) for x in search.LOOKUPS["CharField"]], *[(f"nation_id__{x}", 2, 1) for x in search.LOOKUPS["AutoField"]], *[(f"nation__{n}", 2, 1) for n in _CATALOG.members["shop.Nation"]]))
query("C02_field_operators", lambda s, d: _fields(s).where("not is_relation").join(F.broadcast(search.lookup_table(s)), "kind").groupBy("model").agg(F.count("*").alias("n")), f"WITH {_FIELDS_SQL}, lookups AS ({_values('kind, lookup', *[(k, n) for k, ns in search.LOOKUPS.items() for n in ns])}) SELECT model, count(*) AS n FROM fields JOIN lookups USING (kind) WHERE target IS NULL GROUP BY 1")
_NAMES = "SELECT DISTINCT p_name AS name FROM part"
query("C04_candidates", lambda s, d: search.candidates(_table(s, d, "part").select(F.col("p_name").alias("name")).distinct(), "name", "Small").select("name", "tier"), f"SELECT name, CAST(CASE WHEN starts_with(name, 'Small') THEN 0 ELSE 1 END AS BIGINT) AS tier FROM ({_NAMES}) WHERE starts_with(lower(name), 'small')")
query("C05_fuzzy", lambda s, d: search.fuzzy(_table(s, d, "customer").select(F.col("c_name").alias("name")), "name", "Customer#000000017").select("name", F.col("distance").cast("long").alias("distance")), "SELECT c_name AS name, levenshtein(lower(c_name), 'customer#000000017') AS distance FROM customer WHERE levenshtein(lower(c_name), 'customer#000000017') BETWEEN 1 AND 2")
query("C06_prefix_folded", lambda s, d: search.with_prefix(_table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key")), "name", "COLD", 1_000_000, True), "SELECT p_name AS name, p_partkey AS key FROM part WHERE starts_with(lower(p_name), 'cold')")
query("C07_relation_targets", lambda s, d: search.relation_targets(_models(s), "shop.models.P").select("label"), _values("label", ("shop.Part",), ("shop.Page",)))
query("C08_members_by_prefix", lambda s, d: surface.members(_models(s), _fields(s)).where("model = 'shop.Part' and receiver = 'queryset' and startswith(name, 'ex')").select("name"), _values("name", ("exclude",), ("exists",), ("explain",), ("extra",)))
query("O10_prefix_limit", lambda s, d: search.with_prefix(_table(s, d, "customer").select(F.col("c_name").alias("name")), "name", "Customer#0000001", 50), "SELECT c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_name LIMIT 50")
query("O11_edge_order", lambda s, d: metadata.edges(_fields(s)).orderBy(F.when(F.col("direction") == "forward", 0).otherwise(1), "target", F.get("field_names", F.lit(0))).limit(10).select("source", "target", "direction"), f"WITH {_FIELDS_SQL} SELECT source, target, direction FROM (SELECT model AS source, target, direction, min(name) AS f FROM fields WHERE target IS NOT NULL GROUP BY 1, 2, 3) ORDER BY CASE WHEN direction = 'forward' THEN 0 ELSE 1 END, target, f LIMIT 10")
query("R11_relation_target", lambda s, d: search.resolved_targets(s.createDataFrame([(1, "shop.Part", ""), (2, "Nation", ""), (3, "shop.models.Order", ""), (4, "self", "shop.Event"), (5, "Nobody", ""), (6, "self", None)], "id int, ref string, context string"), _models(s)).select("id", "target", "reason"), _values("id, target, reason", (1, "shop.Part", ""), (2, "shop.Nation", ""), (3, "shop.Order", ""), (4, "shop.Event", ""), (5, None, "not_found"), (6, None, "missing_context")))
query("U05_first_wins", lambda s, d: search.first_wins(*(s.createDataFrame(r, "name string, v int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)])), key="name"), _values("name, v", ("a", 1), ("b", 2), ("c", 4)))
#: Paths to validate: model, method, path, reason, missing segment, last field.
PATHS = (
    ("shop.LineItem", "filter", "order__customer__nation__name__startswith", "", "", "name"), ("shop.LineItem", "filter", "order__customer__nope", "invalid_lookup_operator", "nope", "customer"),
    ("shop.LineItem", "filter", "quantity__contains", "invalid_lookup_operator", "contains", "quantity"), ("shop.Order", "filter", "orderdate__year__gte", "", "", "orderdate"), ("shop.Order", "order_by", "-customer__acctbal", "", "", "acctbal"),
    ("shop.Order", "select_related", "customer__nation", "", "", "nation"), ("shop.Order", "select_related", "status", "relation_required", "", "status"), ("shop.Order", "values", "status__x", "non_relation_intermediate", "status", "status"),
    ("shop.Order", "only", "customer__zip", "segment_not_found", "zip", "customer"), ("shop.Customer", "filter", "", "empty", "", ""), ("shop.Customer", "filter", "orders__lines__part__name__icontains", "", "", "name"),
    ("shop.Customer", "filter", "nation__isnull", "", "", "nation"), ("shop.Customer", "filter", "zzz__exact", "segment_not_found", "zzz", ""), ("shop.Part", "filter", "name__lower__length__gt", "", "", "name"), ("shop.Order", "filter", "orderdate__year__contains", "invalid_lookup_operator", "contains", "orderdate"),
)


def _usages(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, m, k, p) for i, (m, k, p, *_) in enumerate(PATHS)], "id int, model string, method string, path string")


query("R09_validate_paths", lambda s, d: search.validated(_usages(s), _fields(s)).select("id", "reason", "missing", "target"), _values("id, reason, missing, target", *[(i, r, x, t) for i, (*_, r, x, t) in enumerate(PATHS)]))
query("R01_resolve_paths", lambda s, d: search.validated(_usages(s), _fields(s)).select("id", "reason"), _values("id, reason", *[(i, r) for i, (*_, r, _x, _t) in enumerate(PATHS)]))
query("D04_diagnostics", lambda s, d: search.diagnostics(search.validated(_usages(s), _fields(s))).groupBy("severity").agg(F.count("*").alias("n")), _values("severity, n", ("error", sum(1 for p in PATHS if p[3]))))
query("D05_unfinished", lambda s, d: search.without_unfinished(search.validated(_usages(s), _fields(s)), s.createDataFrame([(12, "zzz__exactly")], "id int, name string")).select("id"), _values("id", *[(i,) for i, p in enumerate(PATHS) if p[3] and i != 12]))

# ---- telemetry -----------------------------------------------------------------------------------------------

query("A19_usage", lambda s, d: telemetry.usage(_table(s, d, "events"), "user_id", 500), "SELECT user_id AS name, count(*) AS uses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
query("A20_latency", lambda s, d: telemetry.latency(_table(s, d, "events"), "event_type", "value").drop("mean"), "SELECT event_type, count(value) AS count, list_sort(list(value))[CAST(floor(count(value) * 0.5) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(value) * 0.95) AS INT) + 1] AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
query("A21_gauges", lambda s, d: telemetry.gauges(_table(s, d, "events"), "event_type", "ts", "event_id").drop("last"), "SELECT event_type, count(*) AS total FROM events GROUP BY 1")

# ---- what source names ------------------------------------------------------------------------------------------

USES = {
    "farm/views.py": "from django.db.models import Count, F, Prefetch, Q\nfrom . import Horse, Stable\nqs = Horse.objects.filter(home__name__startswith='A', **{'dam__rank__gt': 2}).exclude(Q(rank=1) | Q(foals__weight__lt=3))\nfor horse in qs.order_by('-rank', 'home__name'):\n    horse.foals.values('weigth')\n    horse.home.horses.update(rank=F('rank'))\nHorse.objects.select_related('home').prefetch_related(Prefetch('foals'))\ndef count(stable: Stable):\n    return stable.horses.annotate(n=Count('foals')).values_list('label', flat=True)\nHorse.objects.create(rank=3, home=None)\nHorse.objects.bulk_update([], ['rank', 'nope'])\n",
    "farm/more.py": "from django.db import models\nclass Tag(models.Model):\n    text = models.TextField()\n    on = models.ForeignKey('farm.Horse', on_delete=models.CASCADE)\n    class Meta:\n        ordering = ['-text']\n        constraints = [models.UniqueConstraint(fields=['on', 'text'], name='u', condition=models.Q(on__rank__gt=0))]\n",
}
_USED: dict[str, DataFrame] = {}


def _uses(s: SparkSession) -> DataFrame:
    return usages.read_usages(s.createDataFrame(list(USES.items()), "path string, text string"))


def _used(s: SparkSession) -> DataFrame:
    """The usages of USES with their models, over the project and the module that they declare."""
    key = s.sparkContext.applicationId
    if key not in _USED:
        files = project_files(s).select("path", "text").unionByName(s.createDataFrame([(p, USES[p]) for p in ("farm/more.py",)], "path string, text string"))
        made = metadata.build(read_modules(files).unionByName(read_modules(s.createDataFrame([("farm/views.py", USES["farm/views.py"])], "path string, text string"))))
        _USED[key] = metadata.stored(usages.located(_uses(s), made, surface.members(made.models, made.fields)))
    return _USED[key]


query("D01_lookup_usages", lambda s, d: _uses(s).where("context = 'lookup'").select("path", "line", "method", "value"), _values("path, line, method, value",
      *[("farm/views.py", n, m, v) for n, m, v in ((3, "filter", "home__name__startswith"), (3, "filter", "dam__rank__gt"), (3, "filter", "rank"), (3, "filter", "foals__weight__lt"), (4, "order_by", "-rank"), (4, "order_by", "home__name"), (5, "values", "weigth"), (6, "values", "rank"), (9, "values", "foals"), (9, "values_list", "label"))], ("farm/more.py", 7, "filter", "on__rank__gt")))
query("D02_direct_usages", lambda s, d: _uses(s).where("context in ('direct', 'schema')").select("path", "line", "method", "value"), _values("path, line, method, value",
      ("farm/views.py", 6, "update", "rank"), ("farm/views.py", 10, "create", "rank"), ("farm/views.py", 10, "create", "home"), ("farm/views.py", 11, "bulk_update", "rank"), ("farm/views.py", 11, "bulk_update", "nope"), ("farm/more.py", 6, "ordering", "-text"), ("farm/more.py", 7, "UniqueConstraint", "on"), ("farm/more.py", 7, "UniqueConstraint", "text")))
query("D03_relation_usages", lambda s, d: _uses(s).where("context in ('relation', 'relation_target')").select("path", "line", "context", "value"), _values("path, line, context, value", ("farm/views.py", 7, "relation", "home"), ("farm/views.py", 7, "relation", "foals"), ("farm/more.py", 4, "relation_target", "farm.Horse")))
query("D06_receivers", lambda s, d: _uses(s).where("path = 'farm/views.py'").select("line", "value", "ref", "receiver", F.array_join("names", ".").alias("names")).where("line in (3, 5, 6, 9)").distinct(), _values("line, value, ref, receiver, names",
      (3, "home__name__startswith", "Horse", "model_class", "objects"), (3, "dam__rank__gt", "Horse", "model_class", "objects"), (3, "rank", "Horse", "model_class", "objects.filter"), (3, "foals__weight__lt", "Horse", "model_class", "objects.filter"), (5, "weigth", "Horse", "model_class", "objects.filter.exclude.order_by.first.foals"), (6, "rank", "Horse", "model_class", "objects.filter.exclude.order_by.first.home.horses"), (9, "foals", "Stable", "instance", "horses"), (9, "label", "Stable", "instance", "horses.annotate")))
query("Z28_receiver_models", lambda s, d: _used(s).select("path", "line", "value", "model").where("line in (3, 5, 6, 7, 9)").distinct(), _values("path, line, value, model",
      *[("farm/views.py", n, v, "farm.Horse") for n, v in ((3, "home__name__startswith"), (3, "dam__rank__gt"), (3, "rank"), (3, "foals__weight__lt"), (5, "weigth"), (6, "rank"), (7, "home"), (7, "foals"), (9, "foals"), (9, "label"))], ("farm/more.py", 6, "-text", "farm.Tag"), ("farm/more.py", 7, "on", "farm.Tag"), ("farm/more.py", 7, "text", "farm.Tag"), ("farm/more.py", 7, "on__rank__gt", "farm.Tag")))

# ---- more of the graph, and of the index ---------------------------------------------------------------------------

query("G07_inherited_reverse", lambda s, d: project(s).fields.where("model = 'farm.Foal' and direction = 'reverse'").select("name", "target", "provenance"), _values("name, target, provenance", ("foals", "farm.Horse", "inherited"), ("pass", "farm.Pass", "inherited"), ("shoe_set", "store.Shoe", "inherited"), ("worn", "store.Shoe", "related_query_alias")))
query("G11_long_chain", lambda s, d: metadata.reachable(s.range(60).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"), F.lit("forward").alias("direction")), "n0"), "SELECT 'n' || i AS node, i AS level FROM range(61) t(i)")
query("J14_importers", lambda s, d: metadata.importers(read_modules(project_files(s))).where("source like 'farm%'").select("source", "symbol", F.array_join("importers", ",").alias("importers")), _values("source, symbol, importers", ("farm.api", "*", "farm"), ("farm.base", "Stamped", "farm,farm.animals"), ("farm.animals", "Horse", "farm.api"), ("farm.animals", "Stable", "farm.api"), ("farm", "base", "farm.api"), ("farm.base", "Ranked", "farm.animals"), ("farm.base", "Key", "farm.animals"), ("farm.base", "", "farm.animals"), ("farm", "Horse", "store.models")))
_RUNTIME = "label string, module string, name string"
_LIVE = [("stud.Horse", "farm.animals", "Horse"), ("farm.Pass", "elsewhere", "Pass")]
query("J15_label_map", lambda s, d: metadata.label_map(project(s).models, s.createDataFrame(_LIVE, _RUNTIME)), _values("label, runtime_label", ("farm.Horse", "stud.Horse"), ("farm.Pass", "farm.Pass"), *[(x, None) for x in ("farm.Stamped", "farm.Ranked", "farm.Stable", "farm.Foal", "store.Shoe")]))
query("Z08_relabelled", lambda s, d: metadata.relabelled(project(s).fields, metadata.label_map(project(s).models, s.createDataFrame(_LIVE, _RUNTIME))).where("model = 'stud.Horse' and direction = 'forward' or target = 'stud.Horse' and direction = 'forward'").select("model", "name", "target", "declared_on"), _values("model, name, target, declared_on", ("stud.Horse", "home", "farm.Stable", "stud.Horse"), ("stud.Horse", "dam", "stud.Horse", "stud.Horse"), ("stud.Horse", "shoes", "store.Shoe", "stud.Horse"), ("farm.Foal", "dam", "stud.Horse", "stud.Horse"), ("farm.Pass", "horse", "stud.Horse", "farm.Pass"), ("store.Shoe", "worn_by", "stud.Horse", "store.Shoe")))
query("C03_virtual_completions", lambda s, d: search.virtual_completions(s.createDataFrame([("total", "DecimalField"), ("tot_name", "CharField"), ("n", "IntegerField")], "name string, kind string"), "tot").select("name", "group").unionByName(search.virtual_completions(s.createDataFrame([("n", "IntegerField")], "name string, kind string"), "n__g").select("name", "group")), _values('name, "group"', ("total", 0), ("tot_name", 0), *[(f"n__{x}", 2) for x in search.LOOKUPS["IntegerField"] if x.startswith("g")]))
query("C10_without_aliases", lambda s, d: search.without_aliases(project(s).fields).where("model = 'farm.Horse' and direction = 'reverse'").select("name"), _values("name", ("foals",), ("pass",), ("shoe_set",)))
query("P12_target_previews", lambda s, d: search.target_previews(metadata.nodes(_fields(s))).select("model", "n_field_names", F.size("field_names").alias("shown")), f"WITH {_FIELDS_SQL}, p AS (SELECT model, count(DISTINCT name) FILTER (target IS NULL) AS n FROM fields GROUP BY 1) SELECT model, n AS n_field_names, least(n, 8) AS shown FROM p")
query("S05_settings_choice", lambda s, d: source_files.settings_choice(s.createDataFrame([("manage.py",), ("tools/manage.py",), ("site/settings.py",), ("site/urls.py",)], "path string")), _values("entry, settings, n_candidates", ("manage.py", "site.settings", 1)))
query("G19_last_resort", lambda s, d: metadata.last_resort(project(s).fields.where("model <> 'farm.Foal'"), project(s).models, project(s).modules).select("model", "name"), _values("model, name", *[("farm.Foal", n) for n in ("home", "dam", "shoes", "made_at", "label", "rank", "foals", "pass", "shoe_set", "worn")]))
_MANAGED = "from django.db import models\nclass BaseSet(models.QuerySet):\n    def recent(self) -> 'QuerySet':\n        return self\nclass NoteSet(BaseSet):\n    def mine(self):\n        return 1\nMade = models.Manager.from_queryset(NoteSet)\nclass Note(models.Model):\n    text = models.TextField()\n    kept = NoteSet.as_manager()\nclass Memo(Note):\n    pass\n"
query("Z10_managers", lambda s, d: (lambda m: surface.manager_methods(m.modules, m.models, m.bases))(metadata.build(read_modules(s.createDataFrame([("pad/models.py", _MANAGED)], "path string, text string")))), _values("model, receiver, name, return_kind", *[(m, r, n, k) for m in ("pad.Note", "pad.Memo") for r, n, k in (("model_class", "kept", "manager"), ("manager", "recent", "queryset"), ("queryset", "recent", "queryset"), ("manager", "mine", "unknown"), ("queryset", "mine", "unknown"))]))
query("K37_lookup_kinds", lambda s, d: search.lookup_table(s).groupBy("kind").agg(F.count("*").alias("n")), f"SELECT kind, count(*) AS n FROM ({_values('kind, lookup', *[(k, n) for k, ns in search.LOOKUPS.items() for n in ns])}) GROUP BY 1")
query("J13_bound_imports", lambda s, d: project(s).exports.where("size(via) > 0").groupBy("origin_module").agg(F.count("*").alias("n")), _values("origin_module, n", ("farm.animals", 5), ("farm.base", 4), ("store.loop_b", 1)))
query("G12_package_wins", lambda s, d: read_modules(s.createDataFrame([("k/m.py", "class A: pass"), ("k/m/__init__.py", "class B: pass")], "path string, text string")).select("path", "module"), _values("path, module", ("k/m/__init__.py", "k.m")))
query("G13_type_checking", lambda s, d: read_modules(s.createDataFrame([("a/b.py", "if TYPE_CHECKING:\n    from .x import Y\nif True:\n    from .z import W\n")], "path string, text string")).select(F.explode("imports").alias("i")).select("i.source", "i.symbol"), _values("source, symbol", ("a.x", "Y")))
_EDITS = [("store/models.py", PROJECT["store/models.py"].replace("size", "width"), False, 1), ("store/loop_a.py", None, True, 1), ("farm/base.py", "class broken(:", False, 1)]
query("I01_reindexed", lambda s, d: incremental.applied(read_modules(project_files(s)), s.createDataFrame(_EDITS, incremental.CHANGE)).select("path", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields")), _values("path, fields", ("farm/__init__.py", ""), ("farm/api.py", ""), ("farm/base.py", "made_at,label,rank,label"), ("farm/animals.py", "name,home,dam,shoes,weight,horse"), ("farm/broken.py", ""), ("store/__init__.py", ""), ("store/models.py", "width,worn_by"), ("store/loop_b.py", "")))
query("I02_model_parts", lambda s, d: source_files.changes(incremental.model_part(read_modules(project_files(s))), incremental.model_part(incremental.applied(read_modules(project_files(s)), s.createDataFrame([*_EDITS, ("farm/animals.py", PROJECT["farm/animals.py"].replace("return 3", "return 4"), False, 1)], incremental.CHANGE)))), _values("path, change", ("store/models.py", "changed"), ("store/loop_a.py", "removed")))
query("I03_affected", lambda s, d: incremental.affected(s.createDataFrame([("farm.Ranked",)], "label string"), project(s).bases, metadata.edges(project(s).fields)), _values("label", *[(f"farm.{x}",) for x in ("Ranked", "Horse", "Foal", "Pass", "Stable")], ("store.Shoe",)))
query("I04_partial_rebuild", lambda s, d: incremental.replaced(s.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "model string, v int"), s.createDataFrame([("b", 2), ("d", 2)], "model string, v int"), s.createDataFrame([("b",), ("c",), ("d",)], "label string")), _values("model, v", ("a", 1), ("b", 2), ("d", 2)))
query("O06_completion_order", lambda s, d: search.completions(_fields(s), "shop.Order", "customer__na", "filter").limit(3).select("name", "is_relation"), _values("name, is_relation", ("nation", True), ("name", False), ("nation_id", False)))
query("R05_alias_visibility", lambda s, d: search.visible(project(s).fields, "only").where("model = 'farm.Horse' and direction = 'reverse'").select("name"), _values("name", ("foals",), ("pass",), ("shoe_set",)))
query("R09_long_paths", lambda s, d: search.validated(s.createDataFrame([(1, "shop.LineItem", "filter", "order__customer__nation__customers__orders__lines__order__customer__nation__customers__name__startswith"), (2, "shop.Order", "filter", "customer__orders__" * 12 + "nope")], "id int, model string, method string, path string"), _fields(s)).select("id", "reason", "missing", "target"), _values("id, reason, missing, target", (1, "", "", "name"), (2, "invalid_lookup_operator", "nope", "orders")))
query("Z20_same_app_targets", lambda s, d: project(s).fields.where("direction = 'forward' and provenance = 'declared'").select("model", "name", "target"), _values("model, name, target", ("farm.Horse", "home", "farm.Stable"), ("farm.Horse", "dam", "farm.Horse"), ("farm.Horse", "shoes", "store.Shoe"), ("farm.Pass", "horse", "farm.Horse"), ("store.Shoe", "worn_by", "farm.Horse")))
query("D08_surface_fingerprints", lambda s, d: surface.fingerprints(surface.members(_models(s), _fields(s))).select("model", F.length("fingerprint").alias("n")), _values("model, n", *[(label, 64) for label in _CATALOG.models]))

# ---- a project of many models, by rules that SQL can state ------------------------------------------------------------

#: Models of the project; chains of DEEP of them inherit from each other.
MANY, DEEP = 300, 5


def _many_files(s: SparkSession) -> DataFrame:
    """Model i is Node{i} of app{i}, below Node{i-1} unless i is a multiple of DEEP, and links to Node{7 i mod MANY}."""
    i, t = F.col("id").cast("string"), ((F.col("id") * 7) % MANY).cast("string")
    top = F.col("id") % DEEP == 0
    up = (F.col("id") - 1).cast("string")
    text = F.concat(
        F.lit("from django.db import models\n"), F.when(top, "").otherwise(F.concat(F.lit("from app"), up, F.lit(".models import Node"), up, F.lit("\n"))),
        F.lit("class Node"), i, F.lit("("), F.when(top, "models.Model").otherwise(F.concat(F.lit("Node"), up)), F.lit("):\n    f"), i, F.lit(" = models.IntegerField()\n    link"), i,
        F.lit(" = models.ForeignKey('app"), t, F.lit(".Node"), t, F.lit("', related_name='from"), i, F.lit("', on_delete=models.CASCADE)\n"),
    )
    return s.range(MANY).select(F.concat(F.lit("app"), i, F.lit("/models.py")).alias("path"), text.alias("text"))


def _many(s: SparkSession) -> metadata.Metadata:
    key = f"{s.sparkContext.applicationId} many"
    if key not in _BUILT:
        _BUILT[key] = metadata.build(read_modules(_many_files(s)))
    return _BUILT[key]


#: Pairs of a model i and one j that it is or inherits from.
_UP_SQL = f"n AS (SELECT i FROM range({MANY}) t(i)), up AS (SELECT a.i AS i, b.i AS j FROM n a JOIN n b ON a.i // {DEEP} = b.i // {DEEP} AND b.i <= a.i)"
_LABEL_SQL = "'app' || {0} || '.Node' || {0}"
query("G08_many_bases", lambda s, d: metadata.ancestors(_many(s).bases).select("model", "ancestor", "depth"), f"WITH {_UP_SQL} SELECT {_LABEL_SQL.format('i')} AS model, {_LABEL_SQL.format('j')} AS ancestor, i - j AS depth FROM up WHERE j < i")
query("G10_many_fields", lambda s, d: _many(s).fields.select("model", "name", "kind", "direction", "target", "provenance"),
      f"WITH {_UP_SQL} SELECT {_LABEL_SQL.format('i')} AS model, 'f' || j AS name, 'IntegerField' AS kind, NULL AS direction, NULL AS target, CASE WHEN i = j THEN 'declared' ELSE 'inherited' END AS provenance FROM up "
      f"UNION ALL SELECT {_LABEL_SQL.format('i')}, 'link' || j, 'ForeignKey', 'forward', {_LABEL_SQL.format(f'(j * 7 % {MANY})')}, CASE WHEN i = j THEN 'declared' ELSE 'inherited' END FROM up "
      f"UNION ALL SELECT {_LABEL_SQL.format('up.i')}, 'from' || n.i, 'reverse_ForeignKey', 'reverse', {_LABEL_SQL.format('n.i')}, CASE WHEN up.i = up.j THEN 'reverse' ELSE 'inherited' END FROM up JOIN n ON n.i * 7 % {MANY} = up.j")  # fmt: skip
query("G11_many_reachable", lambda s, d: metadata.reachable(metadata.edges(_many(s).fields), "app1.Node1", False), f"WITH RECURSIVE {_UP_SQL}, r(i, level) AS (SELECT 1, 0 UNION SELECT up.j * 7 % {MANY}, r.level + 1 FROM r JOIN up ON up.i = r.i WHERE r.level < 30) SELECT {_LABEL_SQL.format('i')} AS node, min(level) AS level FROM r GROUP BY i")
_LEAF_SQL = f"{{0}} * 7 % {MANY} - {{0}} % 3"  # the model whose field a path of the i-th one asks for
query("R07_many_reasons", lambda s, d: search.validated(s.range(MANY).select("id", F.concat(F.lit("app"), "id", F.lit(".Node"), "id").alias("model"), F.lit("filter").alias("method"), F.expr(f"concat('link', id, '__f', {_LEAF_SQL.format('id')})").alias("path")), _many(s).fields).select("id", "resolved", "reason", "missing"),
      f"WITH t AS (SELECT i, i * 7 % {MANY} AS t, {_LEAF_SQL.format('i')} AS k FROM range({MANY}) t(i)), g AS (SELECT *, t // {DEEP} = k // {DEEP} AND k >= 0 AS ok FROM t) SELECT i AS id, ok AS resolved, CASE WHEN ok THEN '' ELSE 'invalid_lookup_operator' END AS reason, CASE WHEN ok THEN '' ELSE 'f' || k END AS missing FROM g")
query("R10_direct_names", lambda s, d: search.direct_errors(s.range(MANY).select("id", F.concat(F.lit("app"), "id", F.lit(".Node"), "id").alias("model"), F.concat(F.when(F.col("id") % 4 == 3, "from").otherwise("f"), (F.col("id") - F.col("id") % 3).cast("string"), F.when(F.col("id") % 4 == 1, "__gt").otherwise("")).alias("name")), _many(s).fields).select("id"),
      f"SELECT i AS id FROM range({MANY}) t(i) WHERE i % 4 IN (1, 3) OR i // {DEEP} <> (i - i % 3) // {DEEP}")
query("O08_most_used", lambda s, d: search.candidates(_table(s, d, "part").select(F.col("p_name").alias("name")).distinct(), "name", "s", _table(s, d, "part").join(_table(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("uses"))).select("name", "tier", "uses"),
      "SELECT p.name, CASE WHEN starts_with(p.name, 's') THEN 0 ELSE 1 END AS tier, coalesce(u.uses, 0) AS uses FROM (SELECT DISTINCT p_name AS name FROM part) p LEFT JOIN (SELECT p_name AS name, count(*) AS uses FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) u USING (name) WHERE starts_with(lower(p.name), 's')")
query("O09_runtime_first", lambda s, d: search.relation_targets(_many(s).models, "app1", s.range(0, MANY, 2).select(F.concat(F.lit("app"), "id", F.lit(".Node"), "id").alias("label"))).limit(20).select("label", "is_runtime"),
      f"SELECT {_LABEL_SQL.format('i')} AS label, i % 2 = 0 AS is_runtime FROM range({MANY}) t(i) WHERE starts_with('app' || i, 'app1') ORDER BY is_runtime DESC, lower(label) LIMIT 20")
