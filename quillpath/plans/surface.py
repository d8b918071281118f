"""Members that a receiver of a model offers: fields, methods of projects, built-in methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpath.plans.metadata import ancestors, fixpoint, stored

# Built-in methods by receiver and what they return.
_CHAINED = (
    "all", "alias", "annotate", "filter", "exclude", "order_by", "reverse", "distinct", "none", "union", "intersection", "difference",
    "select_related", "prefetch_related", "extra", "defer", "only", "using", "select_for_update",
)
_INSTANCE = (
    "get", "create", "latest", "earliest", "first", "last",
)
_SCALAR = (
    "bulk_update", "update", "delete", "count", "in_bulk", "aggregate", "exists", "contains", "explain",
)
_OTHER = (
    "values", "values_list", "dates", "datetimes", "raw", "get_or_create", "update_or_create", "bulk_create", "iterator",
)
_ASYNC = (
    "aiterator", "acount", "aexists", "afirst", "alast", "aget", "acreate", "aget_or_create", "aupdate_or_create", "abulk_create", "abulk_update",
    "aupdate", "adelete", "alatest", "aearliest", "ain_bulk", "acontains", "aaggregate",
)
_ROW = (
    "save", "delete", "full_clean", "clean", "clean_fields", "validate_unique", "validate_constraints", "refresh_from_db", "serializable_value",
    "get_deferred_fields", "asave", "adelete", "arefresh_from_db", "aclean", "afull_clean",
)
QUERYSET_METHODS = {**dict.fromkeys(_CHAINED, "queryset"), **dict.fromkeys(_INSTANCE, "instance"), **dict.fromkeys(_SCALAR, "scalar"), **dict.fromkeys(_OTHER, "unknown"), **dict.fromkeys(_ASYNC, "unknown")}
BUILTINS: dict[str, dict[str, str]] = {
    "queryset": QUERYSET_METHODS,
    "manager": QUERYSET_METHODS | {"get_queryset": "queryset"},
    "related_manager": QUERYSET_METHODS | {"get_queryset": "queryset"},
    "instance": dict.fromkeys(_ROW, "scalar"),
    "model_class": {"objects": "manager"},
}
COLUMNS = ["model", "receiver", "name", "return_kind", "return_model", "member_kind", "field_kind"]


def builtins(spark: SparkSession) -> DataFrame:
    rows = [(r, n, k) for r, methods in BUILTINS.items() for n, k in methods.items()]
    return spark.createDataFrame(rows, "receiver string, name string, return_kind string")


def members(models: DataFrame, fields: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """COLUMNS for every model and receiver. Of one name a field goes before a project's method, and that before a built-in one.

    methods has model, receiver, name, return_kind. The small table of built-in methods is broadcast.
    """
    spark = models.sparkSession
    many = F.col("kind").contains("ManyToMany") | (F.col("direction") == "reverse") & ~F.col("kind").contains("OneToOne")
    shown = fields.where("provenance <> 'related_query_alias'")
    instance = shown.select(
        "model", F.lit("instance").alias("receiver"), "name",
        F.when(~F.col("is_relation"), "scalar").when(many, "related_manager").otherwise("instance").alias("return_kind"),
        F.col("target").alias("return_model"), F.when(F.col("direction") == "reverse", "reverse_relation").when(F.col("is_relation"), "relation").otherwise("field").alias("member_kind"),
        F.col("kind").alias("field_kind"), F.lit(0).alias("priority"),
    )
    own = F.when(F.col("return_kind").isin("queryset", "instance", "manager"), F.col("label"))
    built = models.select("label").crossJoin(F.broadcast(builtins(spark))).select(F.col("label").alias("model"), "receiver", "name", "return_kind", own.alias("return_model"), F.lit("builtin_method").alias("member_kind"), F.lit(None).cast("string").alias("field_kind"), F.lit(2).alias("priority"))
    everything = instance.unionByName(built)
    if methods is not None:
        everything = everything.unionByName(methods.select("model", "receiver", "name", "return_kind", F.when(F.col("return_kind").isin("queryset", "instance"), F.col("model")).alias("return_model"), F.lit("project_method").alias("member_kind"), F.lit(None).cast("string").alias("field_kind"), F.lit(1).alias("priority")))
    first = F.row_number().over(Window.partitionBy("model", "receiver", "name").orderBy("priority", "member_kind"))
    return everything.withColumn("_n", first).where("_n = 1").select(*COLUMNS)


def project_methods(modules: DataFrame, models: DataFrame) -> DataFrame:
    """model, receiver, name, return_kind of the methods that model classes declare; properties are scalars, class methods are the class's."""
    m = modules.select("module", F.explode("methods").alias("m")).select("module", "m.*")
    owner = models.select("module", F.col("name").alias("class"), F.col("label").alias("model"))
    kind = F.when(F.col("returns").rlike("(?i)queryset"), "queryset").when(F.substring_index(F.regexp_replace("returns", "['\"]", ""), ".", -1) == F.col("class"), "instance").when(F.col("returns") == "", "unknown").otherwise("scalar")
    return m.join(owner, ["module", "class"]).where("not startswith(name, '__')").select("model", F.when(F.col("decorator").isin("classmethod", "staticmethod"), "model_class").otherwise("instance").alias("receiver"), "name", kind.alias("return_kind"))


def manager_methods(modules: DataFrame, models: DataFrame, bases: DataFrame) -> DataFrame:
    """model, receiver, name, return_kind: manager names of models and of their ancestors (receiver model_class),
    and the methods of the manager and queryset classes behind them, through class bases and from_queryset.

    A manager is an assignment to a class attribute of a call whose class name is found among the classes by its last part.
    """
    calls = modules.select("module", F.explode("fields").alias("f")).select("module", "f.*")
    owner = models.select("module", F.col("name").alias("class"), F.col("label").alias("model"))
    # classes by bare name, their own methods, and the classes that they take methods from
    classes = modules.select(F.explode("classes").alias("c")).select(F.col("c.name").alias("class"), F.explode("c.bases").alias("base")).select("class", F.substring_index("base", ".", -1).alias("base"))
    aliases = modules.select(F.explode("aliases").alias("a")).select(F.col("a.name").alias("class"), F.substring_index("a.value", ".", -1).alias("base"))
    onward = classes.unionByName(aliases).distinct()
    marks = ("Manager", "QuerySet")
    like = F.lit(False)
    for m in marks:
        like = like | F.col("base").endswith(m)
    start = onward.where(like).select("class").distinct()
    known = fixpoint(start, lambda new: onward.join(new.select(F.col("class").alias("base")), "base").select("class"), ["class"])
    declared = calls.withColumn("maker", F.element_at(F.filter(F.split("call", r"\."), lambda p: ~p.isin("as_manager", "from_queryset")), -1))
    declared = declared.join(owner, ["module", "class"]).select("model", "name", "maker")
    declared = declared.join(known.select(F.col("class").alias("maker")), "maker", "left_semi").unionByName(declared.where(F.col("maker").endswith("Manager"))).distinct()
    up = ancestors(bases).select("model", F.col("ancestor").alias("_from"))
    own = declared.unionByName(up.join(declared.withColumnRenamed("model", "_from"), "_from").select("model", "name", "maker")).distinct()
    reach = fixpoint(own.select("maker", F.col("maker").alias("class")).distinct(), lambda new: new.join(onward, "class").select("maker", F.col("base").alias("class")), ["maker", "class"])
    methods = modules.select(F.explode("methods").alias("m")).select(F.col("m.class").alias("class"), F.col("m.name").alias("name"), F.col("m.returns").alias("returns")).where("not startswith(name, '_')")
    kind = F.when(F.col("returns").rlike("(?i)queryset|self"), "queryset").when(F.col("returns") == "", "unknown").otherwise("scalar")
    behind = own.select("model", "maker").distinct().join(reach, "maker").join(methods, "class").select("model", F.explode(F.array(F.lit("manager"), F.lit("queryset"))).alias("receiver"), "name", kind.alias("return_kind"))
    return own.select("model", F.lit("model_class").alias("receiver"), "name", F.lit("manager").alias("return_kind")).unionByName(behind).distinct()


def fingerprints(surface: DataFrame) -> DataFrame:
    """model, fingerprint: SHA-256 of the sorted members of a model."""
    row = F.to_json(F.struct(*COLUMNS[1:]))
    return surface.groupBy("model").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("fingerprint"))


def chain(surface: DataFrame, starts: DataFrame) -> DataFrame:
    """id, model, receiver that names (an array) lead to from (model, receiver), one join for each place of the longest array; receiver is null where a name is missing."""
    at = starts.select("id", "model", "receiver", "names")
    step = surface.select(F.col("model").alias("_m"), F.col("receiver").alias("_r"), F.col("name").alias("_n"), "return_kind", "return_model")
    for i in range(at.agg(F.coalesce(F.max(F.size("names")), F.lit(0))).first()[0]):
        name = F.get("names", F.lit(i))
        joined = at.join(step, (at["model"] == step["_m"]) & (at["receiver"] == step["_r"]) & (name == step["_n"]), "left")
        done = name.isNull()
        at = _cut(i, joined).select("id", F.when(done, F.col("model")).otherwise(F.col("return_model")).alias("model"), F.when(done, F.col("receiver")).otherwise(F.col("return_kind")).alias("receiver"), "names")
    return at.select("id", "model", "receiver")


def _cut(i: int, df: DataFrame) -> DataFrame:
    """df, with its lineage cut at every eighth join."""
    return stored(df) if i % 8 == 7 else df


def hydrated(surface: DataFrame) -> DataFrame:
    """fields as far as a surface tells: its instance members that are fields or relations."""
    f = surface.where("receiver = 'instance' and field_kind is not null")
    return f.select("model", "name", F.col("field_kind").alias("kind"), (F.col("member_kind") != "field").alias("is_relation"), F.when(F.col("member_kind") == "relation", "forward").when(F.col("member_kind") == "reverse_relation", "reverse").alias("direction"), F.col("return_model").alias("target"))
