"""Keys and references found in the tables themselves.

A column without nulls and repeats is a key. A column refers to a key if all its values are among the key's. Values alone say too much of
small numbers, so a reference must also have the key's name without its table's prefix. Names, then profiles leave few columns, whose values
are grouped once for all pairs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpath.plans.catalog import Catalog, Field
from quillpath.plans.metadata import reverse_relations, stored

_KINDS = {"bigint": "number", "int": "number", "smallint": "number", "tinyint": "number", "string": "text"}


def stem(column: str) -> str:
    """A column's name without the prefix of one or two letters that names its table."""
    head, mark, tail = column.partition("_")
    return tail if mark and len(head) <= 2 and tail else column


def profile(tables: dict[str, DataFrame], only: set[tuple[str, str]] | None = None) -> DataFrame:
    """table, column, kind, rows, present, about, low, high of every column of whole numbers or text (with only, of those tables and columns): one pass
    for each table. about is the number
    of different values, within some hundredths; low and high are texts."""
    parts = []
    for name, df in tables.items():
        columns = [c for c, t in df.dtypes if t in _KINDS and (only is None or (name, c) in only)]
        if not columns:
            continue
        each = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(_KINDS[dict(df.dtypes)[c]]).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count(f"`{c}`").alias("present"), F.approx_count_distinct(f"`{c}`", 0.02).alias("about"), F.min(f"`{c}`").cast("string").alias("low"), F.max(f"`{c}`").cast("string").alias("high")) for c in columns]
        parts.append(df.agg(F.array(*each).alias("each")).select(F.inline("each")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """source_table, source_column, target_table, target_column, values (different ones of the source), orphans (rows of the source whose
    value the target has not, 0 in all) and used (the share of the target's values that the source has).

    Profiles come to the driver, one row for each column whose name another table has; values stay in Spark. Each value is counted in all columns of
    a name at once, by one shuffle of numbers and one of texts, which tells of every pair how many are missing and of every key whether it repeats. Where each of two keys holds the other, the
    table with the shorter name of its own key (its stem begins the table's name) is the target, else both are given.
    """
    spark = next(iter(tables.values())).sparkSession
    named: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for t, df in tables.items():
        for c, kind in df.dtypes:
            if kind in _KINDS:
                named.setdefault((_KINDS[kind], stem(c)), []).append((t, c))
    shared = {at for ats in named.values() if len({t for t, _ in ats}) > 1 for at in ats}
    about = {(r["table"], r["column"]): r for r in profile(tables, shared).collect()} if shared else {}
    keys = [at for at, r in about.items() if r["rows"] and r["present"] == r["rows"] and r["about"] >= 0.9 * r["rows"]]
    order = lambda r, v: int(v) if r["kind"] == "number" else v
    pairs = []
    for source, s in about.items():
        for target in keys:
            t = about[target]
            if source[0] == target[0] or s["kind"] != t["kind"] or not s["present"] or stem(source[1]) != stem(target[1]):
                continue
            if s["about"] <= 1.2 * t["about"] and order(s, s["low"]) >= order(t, t["low"]) and order(s, s["high"]) <= order(t, t["high"]):
                pairs.append((source, target))
    schema = "source_table string, source_column string, target_table string, target_column string, values long, orphans long, used double"
    found = spark.createDataFrame([], schema)
    for kind, type_ in (("number", "long"), ("text", "string")):
        of_kind = [p for p in pairs if about[p[0]]["kind"] == kind]
        if of_kind:
            found = found.unionByName(_counted(tables, of_kind, type_, {at: r["rows"] for at, r in about.items()}))
    return stored(found.where("orphans = 0"))


def _counted(tables: dict[str, DataFrame], pairs: list[tuple[tuple[str, str], tuple[str, str]]], type_: str, rows: dict[tuple[str, str], int]) -> DataFrame:
    """The rows of references for pairs of columns (source, target) whose target repeats no value, orphans or not."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for at in dict.fromkeys(at for p in pairs for at in p):
        groups.setdefault(stem(at[1]), []).append(at)
    place = {at: (g, i) for g, ats in groups.items() for i, at in enumerate(ats)}
    every = None
    for (t, c), (g, i) in place.items():
        part = tables[t].select(F.lit(g).alias("g"), F.col(f"`{c}`").cast(type_).alias("value"), F.lit(i).alias("i")).where("value is not null")
        every = part if every is None else every.unionByName(part)
    counts = every.groupBy("g", "value").agg(*(F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(max(map(len, groups.values())))))
    each = []
    for source, target in pairs:
        (g, i), (_, j) = place[source], place[target]
        here, s, t = F.col("g") == g, F.col(f"n{i}"), F.col(f"n{j}")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        names = (F.lit(x).alias(n) for x, n in zip((*source, *target), ("source_table", "source_column", "target_table", "target_column"), strict=True))
        each.append(F.struct(*names, F.count_if(here & (s > 0)).alias("values"), total(F.when(here & (t == 0), s)).alias("orphans"), (F.count_if(here & (s > 0) & (t > 0)) / F.lit(rows[target])).alias("used"), F.max(F.when(here, t)).alias("most")))
    return counts.agg(F.array(*each).alias("each")).select(F.inline("each")).where("most <= 1").drop("most")


#: Field kinds by column types.
_FIELD_KINDS = {"bigint": "BigIntegerField", "int": "IntegerField", "smallint": "SmallIntegerField", "string": "CharField", "double": "FloatField", "float": "FloatField", "boolean": "BooleanField", "date": "DateField", "timestamp": "DateTimeField", "timestamp_ntz": "DateTimeField", "binary": "BinaryField"}


def fields_of(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """The fields of tables as metadata has them, each table a model of its name: plain columns by their stems, references by the name of the
    table that they lead to (by the column's stem where several lead there), and what those put on their targets."""
    spark = found.sparkSession
    columns = [(t, c, stem(c), _FIELD_KINDS.get(kind, "DecimalField" if kind.startswith("decimal") else "unknown")) for t, df in tables.items() for c, kind in df.dtypes]
    plain = spark.createDataFrame(columns, "model string, column string, stem string, kind string")
    several = found.groupBy("source_table", "target_table").agg(F.count("*").alias("ways"))
    to = found.join(several, ["source_table", "target_table"]).select(F.col("source_table").alias("model"), F.col("source_column").alias("column"), F.col("target_table").alias("target"), "ways")
    both = plain.join(to, ["model", "column"], "left")
    is_relation = F.col("target").isNotNull()
    name = F.when(is_relation & (F.col("ways") == 1), F.col("target")).otherwise(F.col("stem"))
    forward = both.select("model", name.alias("name"), F.when(is_relation, "ForeignKey").otherwise(F.col("kind")).alias("kind"), is_relation.alias("is_relation"), F.when(is_relation, "forward").alias("direction"), "target", F.col("model").alias("declared_on"), F.lit("").alias("related_name"), F.lit("").alias("related_query_name"), F.lit("runtime").alias("provenance"))
    forward = stored(forward)
    return stored(forward.unionByName(reverse_relations(forward)))


def overlaid(catalog: Catalog, found: DataFrame) -> Catalog:
    """catalog with the references that its models do not declare: the field of the source column becomes a relation to the model of the target
    table, where the target column is that model's key. Declared relations stay as they are. A catalog's models are few, and so are these rows."""
    by_table = {m.table: m for m in catalog.models.values()}
    models = dict(catalog.models)
    for r in found.collect():
        source, target = by_table.get(r["source_table"]), by_table.get(r["target_table"])
        if not source or not target:
            continue
        own = next((f for f in models[source.label].fields if f.column == r["source_column"]), None)
        key = next((f for f in target.fields if f.name == target.pk), None)
        if not own or own.is_relation or not key or key.column != r["target_column"]:
            continue
        made = Field(own.name, "OneToOneField" if own.name == source.pk else "ForeignKey", own.column, target.label, source="runtime")
        models[source.label] = replace(models[source.label], fields=tuple(made if f is own else f for f in models[source.label].fields))
    return Catalog(models)
