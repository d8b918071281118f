"""Model metadata as tables: exports, models, fields, reverse relations, the relation graph.

Everything recursive is a loop of joins that stops when nothing new is found. What each round finds is
written to the shared folder by one job, so plans stay short and survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillpath.functions.lookups import LOOKUPS
from quillpath.plans.catalog import RELATIONS, Catalog

# Further field classes, and endings of base names that mark a model.
FIELD_KINDS = (*LOOKUPS, "IPAddressField", "ParentalKey", "ParentalManyToManyField", "GeneratedField", "CompositePrimaryKey", "CommaSeparatedIntegerField")
MODEL_ENDINGS = ("Model", "Orderable")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillpath-")
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder, which cuts its lineage."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str, int]:
    """df as a table, its path, and its number of rows, all by one job."""
    path, rows = f"{shared_folder(df.sparkSession)}/metadata/{uuid.uuid4().hex}", Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, rows.get["n"]


#: The column of row numbers, and bytes of files that a driver reads in one job where they hold more than one page.
NUMBER, READ_BYTES = "+number", 4 << 20


@dataclass
class Numbered:
    """Rows written once in their order, with what the driver knows of each partition: number, rows before it, its rows, its bytes and files."""

    made: DataFrame  # the rows, whose NUMBER is as each task counted
    parts: list[tuple[int, int, int, int, list[str]]]

    @property
    def count(self) -> int:
        return sum(n for _, _, n, _, _ in self.parts)

    @property
    def width(self) -> float:
        """Bytes of a row in the files, in the partition of the widest."""
        return max((size / n for _, _, n, size, _ in self.parts), default=0.0)

    def rows(self) -> DataFrame:
        """All rows, with their numbers from 0 in NUMBER."""
        before = self.made.sparkSession.createDataFrame([(p, first - (p << 33)) for p, first, *_ in self.parts], "_part long, _shift long")
        shifted = self.made.join(F.broadcast(before), F.shiftright(NUMBER, 33) == F.col("_part"))
        return shifted.withColumn(NUMBER, F.col(NUMBER) + F.col("_shift")).drop("_part", "_shift")

    def between(self, low: int, high: int) -> DataFrame:
        """The rows with numbers from low on and below high in order, from the files alone that hold them."""
        out = self.made.sparkSession.read.schema(self.made.schema)
        some, here = [], F.lit(False)
        for p, first, n, _, files in self.parts:
            a, b = max(low, first), min(high, first + n)
            if a < b:
                some += files
                here = here | F.col(NUMBER).between((p << 33) + a - first, (p << 33) + b - first - 1)
        return out.parquet(*some).where(here).coalesce(1).sortWithinPartitions(NUMBER).drop(NUMBER)


def numbered(df: DataFrame) -> Numbered:
    """df in its order with numbers: each task counts its own rows as it writes them, and the driver gets one count of each partition."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/pages/{uuid.uuid4().hex}"
    df.withColumn(NUMBER, F.monotonically_increasing_id()).write.parquet(path)
    schema = StructType([*df.schema.fields, StructField(NUMBER, LongType())])
    made = spark.read.schema(schema).parquet(path)
    counts = dict(made.groupBy(F.shiftright(NUMBER, 33)).count().collect())
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files: dict[int, list[tuple[str, int]]] = {}
    for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-"):
            files.setdefault(int(name.split("-")[1]), []).append((f"{path}/{name}", f.getLen()))
    parts, first = [], 0
    for p, n in sorted(counts.items()):
        parts.append((p, first, n, sum(size for _, size in files[p]), [name for name, _ in files[p]]))
        first += n
    return Numbered(made, parts)


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of equal keys the least by the columns of order, and then by all others, so that it is always the same."""
    rest = [*order, *(c for c in df.columns if c not in keys and c not in order)]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*(c if c in keys else F.col("_first")[c].alias(c) for c in df.columns))


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], order: tuple[str, ...] = (), better: str = "") -> DataFrame:
    """start and all that step finds from what was new, each combination of keys once: of those found in the round that finds one
    first, the least by order and then by all columns. With better, the name of a column, a later row of less in that column
    counts as new too, and the least stays. It ends when a round finds nothing, so step must give finitely many rows."""
    order = [better, *order] if better else list(order)
    new, path, n = _stored(_first(start, keys, order))
    paths, read = [path], start.sparkSession.read.schema(new.schema)
    while n:
        found = read.parquet(*paths)
        made = _first(step(new).select(*new.columns), keys, order)
        if better:
            known = found.groupBy(*keys).agg(F.min(better).alias("_least"))
            made = made.join(known, keys, "left").where(F.col("_least").isNull() | (F.col(better) < F.col("_least"))).select(*new.columns)
        else:
            made = made.join(found.select(*keys), keys, "left_anti").select(*new.columns)
        new, path, n = _stored(made)
        paths.append(path)
    found = read.parquet(*paths)
    return _first(found, keys, order) if better else found


# ---- exports -------------------------------------------------------------------------------------------


def exports(modules: DataFrame) -> DataFrame:
    """module, symbol, origin_module, origin_symbol, via (modules passed, nearest first), rank.

    A definition goes before an import by name, and that before a star import. A star import takes the
    names of __all__, or those without a leading underscore. A chain does not pass a module twice.
    """
    own = modules.select("module", F.explode("symbols").alias("s")).select("module", F.col("s.symbol").alias("symbol")).distinct()
    none = F.array().cast("array<string>")
    start = own.select("module", "symbol", F.col("module").alias("origin_module"), F.col("symbol").alias("origin_symbol"), none.alias("via"), F.lit(0).alias("rank"))
    bound = modules.select("module", F.explode("imports").alias("i")).select("module", "i.*")
    named = bound.where("not is_star and symbol <> ''").select("module", F.col("source").alias("_from"), F.col("symbol").alias("_name"), F.col("alias").alias("_as"), "ordinal")
    stars = bound.where("is_star").select("module", F.col("source").alias("_from"), "ordinal")
    listed = modules.select(F.col("module").alias("_from"), "explicit_all")

    def step(new: DataFrame) -> DataFrame:
        source = new.select(F.col("module").alias("_from"), F.col("symbol").alias("_name"), "origin_module", "origin_symbol", "via")
        via = F.array_distinct(F.concat(F.array("_from"), F.col("via")))
        fresh = ~F.array_contains("via", F.col("module"))
        by_name = named.join(source, ["_from", "_name"]).where(fresh).select("module", F.col("_as").alias("symbol"), "origin_module", "origin_symbol", via.alias("via"), (F.lit(1000) - F.col("ordinal")).alias("rank"))
        open_ = F.when(F.col("explicit_all").isNotNull(), F.array_contains("explicit_all", F.col("_name"))).otherwise(~F.col("_name").startswith("_"))
        by_star = stars.join(source, "_from").join(listed, "_from").where(fresh & open_).select("module", F.col("_name").alias("symbol"), "origin_module", "origin_symbol", via.alias("via"), (F.lit(1_000_000) - F.col("ordinal")).alias("rank"))
        return by_name.unionByName(by_star)

    found = fixpoint(start, step, ["module", "symbol", "origin_module", "origin_symbol"], ("rank", "via"))
    first = F.row_number().over(Window.partitionBy("module", "symbol").orderBy("rank", F.size("via"), "origin_module", "origin_symbol"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def _reference(refs: DataFrame, modules: DataFrame, exported: DataFrame) -> DataFrame:
    """refs (module, ref and others) with origin_module, origin_symbol of the class that ref names: of
    this module's names, or as an attribute of a module that its first part is bound to."""
    names = exported.select("module", F.col("symbol").alias("ref"), F.col("origin_module").alias("_m1"), F.col("origin_symbol").alias("_s1"))
    bound = modules.select("module", F.explode("imports").alias("i")).where("not i.is_star")
    as_module = bound.select("module", F.col("i.alias").alias("_head"), F.when(F.col("i.symbol") == "", F.col("i.source")).otherwise(F.concat_ws(".", "i.source", "i.symbol")).alias("_target")).dropDuplicates(["module", "_head"])
    last = exported.select(F.col("module").alias("_target"), F.col("symbol").alias("_tail"), F.col("origin_module").alias("_m2"), F.col("origin_symbol").alias("_s2"))
    out = refs.join(names, ["module", "ref"], "left")
    out = out.withColumn("_head", F.substring_index("ref", ".", 1)).withColumn("_tail", F.substring_index("ref", ".", -1))
    out = out.join(as_module, ["module", "_head"], "left").join(last, ["_target", "_tail"], "left")
    return out.withColumn("origin_module", F.coalesce("_m1", "_m2")).withColumn("origin_symbol", F.coalesce("_s1", "_s2")).drop("_m1", "_s1", "_m2", "_s2", "_head", "_tail", "_target")


# ---- models and fields -------------------------------------------------------------------------------------


@dataclass
class Metadata:
    modules: DataFrame
    exports: DataFrame
    models: DataFrame  # label, app, name, module, is_abstract, line
    bases: DataFrame  # model, base (labels), ordinal
    fields: DataFrame  # model, name, kind, is_relation, direction, target, declared_on, related_name, related_query_name, provenance


def models_of(modules: DataFrame, exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models, and their bases that are models. A class is a model if a base's name looks like one, or if a base is one through imports."""
    classes = modules.select("module", F.explode("classes").alias("c")).select("module", "c.*")
    app = F.coalesce("app_label", F.substring_index("module", ".", 1))
    labelled = stored(classes.withColumn("app", app).withColumn("label", F.concat_ws(".", "app", "name")))
    refs = labelled.select("module", F.col("label").alias("model"), F.posexplode("bases").alias("ordinal", "ref"))
    origin = labelled.select(F.col("module").alias("origin_module"), F.col("name").alias("origin_symbol"), F.col("label").alias("base"))
    linked = stored(_reference(refs, modules, exported).join(origin, ["origin_module", "origin_symbol"], "left").select("model", "base", "ordinal", "ref"))
    tail = F.substring_index("ref", ".", -1)
    looks = tail.endswith(MODEL_ENDINGS[0])
    for ending in MODEL_ENDINGS[1:]:
        looks = looks | tail.endswith(ending)
    start = linked.where(looks).select("model").distinct()
    found = fixpoint(start, lambda new: linked.join(new.select(F.col("model").alias("base")), "base", "left_semi").select("model"), ["model"])
    models = labelled.join(found.withColumnRenamed("model", "label"), "label", "left_semi").select("label", "app", "name", "module", "is_abstract", "line")
    bases = linked.join(found.select(F.col("model").alias("base")), "base", "left_semi").select("model", "base", "ordinal")
    return models.dropDuplicates(["label"]), bases


def _kinds(modules: DataFrame, exported: DataFrame) -> DataFrame:
    """module, call, kind: the field class that a call names, by its own name, through assignments or through base classes."""
    calls = modules.select("module", F.explode("fields").alias("f")).select("module", F.col("f.call").alias("call")).distinct()
    known = F.substring_index("ref", ".", -1).isin(*FIELD_KINDS)
    aliases = modules.select("module", F.explode("aliases").alias("a")).select("module", F.col("a.name").alias("symbol"), F.col("a.value").alias("next"))
    classes = modules.select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("symbol"), F.get("c.bases", F.lit(0)).alias("next"))
    onward = aliases.unionByName(classes.where("next is not null")).select(F.col("module").alias("origin_module"), F.col("symbol").alias("origin_symbol"), "next").dropDuplicates(["origin_module", "origin_symbol"])
    start = calls.select("module", "call", F.col("module").alias("at"), F.col("call").alias("ref"))

    def step(new: DataFrame) -> DataFrame:
        here = new.select(F.col("at").alias("module"), "ref", F.col("module").alias("_own"), "call")
        to = _reference(here, modules, exported).join(onward, ["origin_module", "origin_symbol"])
        return to.select(F.col("_own").alias("module"), "call", F.col("origin_module").alias("at"), F.col("next").alias("ref"))

    walked = fixpoint(start, step, ["module", "call", "at", "ref"])
    local = classes.select(F.col("module").alias("at"), F.col("symbol").alias("ref"), F.lit(True).alias("own"))
    ends = walked.join(local, ["at", "ref"], "left").where(known & F.col("own").isNull())
    return ends.groupBy("module", "call").agg(F.min(F.substring_index("ref", ".", -1)).alias("kind"))


def build(modules: DataFrame) -> Metadata:
    """All tables from parsed modules (see sources.modules)."""
    modules = stored(modules.where("error is null"))
    exported = stored(exports(modules))
    models, bases = (stored(x) for x in models_of(modules, exported))
    declared = modules.select("module", F.explode("fields").alias("f")).select("module", "f.*").join(_kinds(modules, exported), ["module", "call"])
    owner = models.select("module", F.col("name").alias("class"), F.col("label").alias("model"), "app")
    declared = stored(declared.join(owner, ["module", "class"]).withColumn("is_relation", F.col("kind").isin(*RELATIONS)))
    forward = declared.drop("target").join(_targets(declared.where("is_relation"), modules, exported, models), ["model", "name"], "left")
    forward = forward.select("model", "name", "kind", "is_relation", F.when(F.col("is_relation"), "forward").alias("direction"), "target", F.col("model").alias("declared_on"), "related_name", "related_query_name", F.lit("declared").alias("provenance"), "ordinal")
    forward = stored(inherited(forward, bases))
    concrete = models.where("not is_abstract").select(F.col("label").alias("model"))
    back = inherited_reverse(stored(reverse_relations(forward.join(concrete, "model", "left_semi"))), forward, bases)
    return Metadata(modules, exported, models, bases, stored(forward.drop("ordinal").unionByName(back)))


def _targets(relations: DataFrame, modules: DataFrame, exported: DataFrame, models: DataFrame) -> DataFrame:
    """model, name, target: a text names the model itself (self), a label, one of its app, or one of a unique name; a symbol names a class."""
    r = relations.select("model", "name", "module", "app", "target_kind", F.col("target").alias("ref"))
    by_label = models.select(F.col("label").alias("ref"), F.col("label").alias("_label"))
    in_app = models.select("app", F.col("name").alias("_short"), F.col("label").alias("_app"))
    unique = models.groupBy(F.col("name").alias("_short")).agg(F.count("*").alias("_n"), F.min("label").alias("_only")).where("_n = 1").drop("_n")
    origin = models.select(F.col("module").alias("origin_module"), F.col("name").alias("origin_symbol"), F.col("label").alias("_symbol"))
    out = _reference(r, modules, exported).withColumn("_short", F.substring_index("ref", ".", -1))
    out = out.join(by_label, "ref", "left").join(in_app, ["app", "_short"], "left").join(unique, "_short", "left").join(origin, ["origin_module", "origin_symbol"], "left")
    target = F.when(F.col("ref") == "self", F.col("model")).when(F.col("target_kind") == "symbol", F.coalesce("_symbol", "_app", "_only")).otherwise(F.coalesce("_label", F.when(~F.col("ref").contains("."), F.coalesce("_app", "_only"))))
    return out.select("model", "name", target.alias("target")).dropDuplicates(["model", "name"])


def ancestors(bases: DataFrame) -> DataFrame:
    """model, ancestor, depth, way: every model that another descends from; way is the first path to it in a search by base order, which
    goes into a base before it goes to the next one. Paths that come round to a model again are not followed."""
    place = F.format_string("%04d", F.col("ordinal"))
    direct = bases.select("model", F.col("base").alias("ancestor"), F.lit(1).alias("depth"), place.alias("way"), F.array("model", "base").alias("_path")).where("model <> ancestor")
    up = bases.select(F.col("model").alias("ancestor"), F.col("base").alias("_next"), place.alias("_place"))

    def step(new: DataFrame) -> DataFrame:
        on = new.join(up, "ancestor").where(~F.array_contains("_path", F.col("_next")))
        return on.select("model", F.col("_next").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.lit("."), "_place").alias("way"), F.array_append("_path", F.col("_next")).alias("_path"))

    return fixpoint(direct, step, ["model", "ancestor"], better="way").drop("_path")


def inherited(fields: DataFrame, bases: DataFrame) -> DataFrame:
    """fields with those of all ancestors; of one name the model's own stands, then the first base's."""
    up = ancestors(bases).select("model", F.col("ancestor").alias("_from"), "way")
    more = up.join(fields.withColumnRenamed("model", "_from"), "_from").withColumn("provenance", F.lit("inherited")).drop("_from")
    both = fields.withColumn("way", F.lit("")).unionByName(more)
    first = F.row_number().over(Window.partitionBy("model", "name").orderBy("way", "ordinal"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "way")


def inherited_reverse(reverse: DataFrame, forward: DataFrame, bases: DataFrame) -> DataFrame:
    """reverse with the reverse fields of all ancestors; names that a model has already, forward or reverse, stay its own."""
    up = ancestors(bases).select("model", F.col("ancestor").alias("_from"), "way")
    taken = forward.select("model", "name").unionByName(reverse.select("model", "name")).distinct()
    more = up.join(reverse.withColumnRenamed("model", "_from"), "_from").join(taken, ["model", "name"], "left_anti")
    nearest = F.row_number().over(Window.partitionBy("model", "name").orderBy("way", "target"))
    more = more.withColumn("_n", nearest).where("_n = 1").withColumn("provenance", F.when(F.col("provenance") == "reverse", "inherited").otherwise(F.col("provenance")))
    return reverse.unionByName(more.select(*reverse.columns))


def last_resort(fields: DataFrame, models: DataFrame, modules: DataFrame) -> DataFrame:
    """Fields for models that have none: those of the classes that their bases name, found by bare name where only one model has it."""
    bare = models.join(fields.select(F.col("model").alias("label")).distinct(), "label", "left_anti")
    named = modules.select("module", F.explode("classes").alias("c")).select("module", F.col("c.name").alias("name"), F.posexplode("c.bases").alias("_place", "_base"))
    unique = object_names(models).where("label is not null").select(F.col("name").alias("_short"), F.col("label").alias("_from"))
    refs = bare.select("label", "module", "name").join(named, ["module", "name"]).withColumn("_short", F.substring_index("_base", ".", -1)).join(unique, "_short").where("_from <> label")
    got = refs.select(F.col("label").alias("model"), "_from", "_place").join(fields.withColumnRenamed("model", "_from"), "_from")
    first = F.row_number().over(Window.partitionBy("model", "name").orderBy("_place", "_from"))
    return got.withColumn("_n", first).where("_n = 1").withColumn("provenance", F.lit("inherited")).select(*fields.columns)


def importers(modules: DataFrame) -> DataFrame:
    """source, symbol, importers: the modules that import a symbol of source ("" the module itself, "*" all), sorted."""
    i = modules.select("module", F.explode("imports").alias("i"))
    return i.groupBy(F.col("i.source").alias("source"), F.when(F.col("i.is_star"), "*").otherwise(F.col("i.symbol")).alias("symbol")).agg(F.array_sort(F.collect_set("module")).alias("importers"))


def label_map(models: DataFrame, runtime: DataFrame) -> DataFrame:
    """label, runtime_label: models of a running project (label, module, name) by module and object name, or by label; null without one."""
    by_name = runtime.select("module", "name", F.col("label").alias("_by_name")).dropDuplicates(["module", "name"])
    by_label = runtime.select("label", F.col("label").alias("_by_label")).dropDuplicates(["label"])
    return models.select("label", "module", "name").join(by_name, ["module", "name"], "left").join(by_label, "label", "left").select("label", F.coalesce("_by_name", "_by_label").alias("runtime_label"))


def relabelled(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """fields with model, target and declared_on by their runtime labels where labels (label, runtime_label) has one."""
    for c in ("model", "target", "declared_on"):
        to = labels.where("runtime_label is not null").select(F.col("label").alias(c), F.col("runtime_label").alias("_new"))
        fields = fields.join(to, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return fields


def refreshed(made: Metadata, modules: DataFrame) -> Metadata:
    """made with modules and exports of new parsed modules; models, fields and the graph stay as they were."""
    modules = stored(modules.where("error is null"))
    return Metadata(modules, stored(exports(modules)), made.models, made.bases, made.fields)


def reverse_relations(forward: DataFrame) -> DataFrame:
    """Fields that relations put on their targets, and their aliases for queries. Names with + are hidden."""
    short = F.lower(F.substring_index("model", ".", -1))
    name = F.when(F.col("related_name") != "", F.col("related_name")).when(F.col("kind") == "OneToOneField", short).otherwise(F.concat(short, F.lit("_set")))
    asked = F.when(F.col("related_query_name") != "", F.col("related_query_name")).when(F.col("related_name") != "", F.col("related_name")).otherwise(short)
    r = forward.where("is_relation and target is not null").withColumn("_name", name).withColumn("_asked", asked).where("not endswith(_name, '+')")
    columns = ["kind", "is_relation", "direction", "target", "declared_on", "related_name", "related_query_name"]

    def made(label: str, provenance: str) -> DataFrame:
        return r.select(F.col("target").alias("model"), F.col(label).alias("name"), F.concat(F.lit("reverse_"), "kind").alias("kind"), F.lit(True).alias("is_relation"), F.lit("reverse").alias("direction"), F.col("model").alias("target"), "declared_on", "related_name", "related_query_name", F.lit(provenance).alias("provenance"))

    aliases = made("_asked", "related_query_alias").join(r.select(F.col("target").alias("model"), F.col("_name").alias("name")).distinct(), ["model", "name"], "left_anti")
    both = made("_name", "reverse").unionByName(aliases.select(*made("_name", "").columns))
    # of one name the relation of the model that declares it, not that of a model that inherits it
    first = F.row_number().over(Window.partitionBy("model", "name").orderBy(F.col("target") != F.col("declared_on"), F.desc("provenance"), "target"))
    return both.withColumn("_n", first).where("_n = 1").select("model", "name", *columns, "provenance")


# ---- graph --------------------------------------------------------------------------------------------------


def edges(fields: DataFrame) -> DataFrame:
    """source, target, direction, field_names, field_kinds (both sorted) of related models."""
    related = fields.where("is_relation and target is not null and provenance <> 'related_query_alias'")
    return related.groupBy(F.col("model").alias("source"), "target", "direction").agg(F.array_sort(F.collect_set("name")).alias("field_names"), F.array_sort(F.collect_set("kind")).alias("field_kinds"))


def reachable(links: DataFrame, start: str, with_reverse: bool = True) -> DataFrame:
    """node, level: models that edges lead to from start, nearest first."""
    links = stored((links if with_reverse else links.where("direction = 'forward'")).select("source", "target").distinct())
    first = links.select(F.lit(start).alias("node"), F.lit(0).alias("level")).limit(1)
    return fixpoint(first, lambda new: new.join(links, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("level") + 1).alias("level")), ["node"])


def object_names(models: DataFrame) -> DataFrame:
    """name, label, n: models by object name; label is set where the name is unique."""
    return models.groupBy("name").agg(F.when(F.count("*") == 1, F.min("label")).alias("label"), F.count("*").alias("n"))


def nodes(fields: DataFrame) -> DataFrame:
    """model and its sorted names of plain fields, relations and reverse relations."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    return fields.groupBy("model").agg(names(~F.col("is_relation")).alias("field_names"), names(F.col("direction") == "forward").alias("relation_names"), names(F.col("direction") == "reverse").alias("reverse_names"))


def statistics(modules: DataFrame, models: DataFrame) -> DataFrame:
    """One row of counts over the index."""
    counts = modules.agg(
        F.count("*").alias("files"), F.count_if("is_package").alias("packages"), F.count_if(F.col("explicit_all").isNotNull()).alias("with_all"),
        F.coalesce(F.sum(F.size(F.filter("imports", lambda i: i["is_star"]))), F.lit(0)).alias("star_imports"), F.coalesce(F.sum(F.size("imports")), F.lit(0)).alias("imports"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return counts.crossJoin(models.agg(F.count("*").alias("models"), F.count_if("is_abstract").alias("abstract_models")))


def overlay(fields: DataFrame, runtime: DataFrame) -> DataFrame:
    """fields with the facts of a running project (model, name, kind, is_relation, target), which stand where they differ; hidden names go."""
    r = runtime.where("not endswith(name, '+')").select("model", "name", F.col("kind").alias("_kind"), F.col("is_relation").alias("_rel"), F.col("target").alias("_target"), F.lit(True).alias("_there"))
    both = fields.join(r, ["model", "name"], "full_outer")
    differs = F.col("_there") & ~(F.col("kind").eqNullSafe(F.col("_kind")) & F.col("is_relation").eqNullSafe(F.col("_rel")) & F.col("target").eqNullSafe(F.col("_target")))
    for name, new in (("kind", "_kind"), ("is_relation", "_rel"), ("target", "_target")):
        both = both.withColumn(f"+{name}", F.when(differs, F.col(new)).otherwise(F.col(name)))
    both = both.withColumn("provenance", F.when(differs, "runtime").otherwise(F.col("provenance")))
    return both.drop("kind", "is_relation", "target", "_kind", "_rel", "_target", "_there").withColumnsRenamed({f"+{n}": n for n in ("kind", "is_relation", "target")})


def catalog_tables(spark, catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """models and fields of a catalog as tables."""
    models = spark.createDataFrame([(m.label, m.label.partition(".")[0], m.name, "shop.models", False, i) for i, m in enumerate(catalog.models.values())], "label string, app string, name string, module string, is_abstract boolean, line int")
    rows = [(label, f.name, f.kind, f.is_relation, f.direction or None, f.target or None, label, f.related_name, f.related_query_name, f.source) for label, fs in catalog.members.items() for f in fs.values()]
    fields = spark.createDataFrame(rows, "model string, name string, kind string, is_relation boolean, direction string, target string, declared_on string, related_name string, related_query_name string, provenance string")
    return models, fields
