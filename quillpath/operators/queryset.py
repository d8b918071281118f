"""Lazy, chainable queries over models. A query is a DataFrame and what is known about its columns.

Columns of the base model have the names of its fields; those of a related model have the path to it
and two underscores before them. A path joins its models once, whatever uses it later. All joins are
left joins, which Catalyst turns into inner ones under a predicate and whose physical form it chooses.
"""

from __future__ import annotations

import asyncio
import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillpath.functions import expressions as E
from quillpath.functions.lookups import predicate, transform
from quillpath.plans.catalog import Catalog, Field
from quillpath.plans.metadata import NUMBER, READ_BYTES, Numbered, numbered
from quillpath.plans.paths import PathError, direct, resolve
from quillpath.sources.versioned import VersionedTable


class DoesNotExist(LookupError):
    pass


class MultipleObjectsReturned(LookupError):
    pass


@dataclass
class Source:
    """Where models' tables are: folders by alias."""

    spark: SparkSession
    catalog: Catalog
    folders: dict[str, str]
    tables: dict[str, DataFrame] = field(default_factory=dict)  # in place of files
    versioned: dict[str, VersionedTable] = field(default_factory=dict)  # tables that queries write to

    def read(self, table: str, alias: str = "default") -> DataFrame:
        if table in self.versioned:
            return self.versioned[table].read()
        return self.tables[table] if table in self.tables else self.spark.read.parquet(f"{self.folders[alias]}/{table}.parquet")

    def objects(self, model: str, cls: type[QuerySet] | None = None) -> QuerySet:
        return (cls or QuerySet).of(self, self.catalog.model(model).label)


@dataclass
class QuerySet:
    source: Source
    label: str
    df: DataFrame
    alias_: str = "default"
    joined: dict[str, str] = field(default_factory=dict)  # path prefix to model
    virtual: dict[str, str] = field(default_factory=dict)  # annotations and their kinds
    hidden: frozenset[str] = frozenset()
    shown: tuple[str, ...] | None = None  # columns of values(), else the model's fields
    extra_shown: tuple[str, ...] = ()  # columns of select_related, prefetch_related and annotations
    grouped: bool = False  # values() came before any annotation
    keys: tuple[tuple[Column, ...], ...] = ()
    sort: tuple[Any, ...] = ()
    outer: tuple[tuple[str, str], ...] = ()  # own column, path of the query around
    deferred: frozenset[str] = frozenset()
    local: tuple[Any, ...] = ()  # a DataFrame, and the conditions on single rows of the table that alone made it

    # ---- beginnings -----------------------------------------------------------------------------

    @classmethod
    def of(cls, source: Source, label: str, alias: str = "default") -> QuerySet:
        out = cls(source, label, None, alias)
        table = out._table(label, "")
        out.df = out.get_queryset(table)
        out.local = (table,)
        return out

    def get_queryset(self, df: DataFrame) -> DataFrame:
        """A hook for subclasses: the rows that their queries begin with."""
        return df

    @property
    def model(self):
        return self.source.catalog.models[self.label]

    def _table(self, label: str, prefix: str) -> DataFrame:
        model = self.source.catalog.models[label]
        return self.source.read(model.table, self.alias_).select(*(F.col(f.column).alias(prefix + f.name) for f in model.fields if f.column))

    def _copy(self, **changes: Any) -> QuerySet:
        out = copy.copy(self)
        for name in ("joined", "virtual"):
            setattr(out, name, dict(getattr(self, name)))
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def all(self) -> QuerySet:
        return self._copy()

    def none(self) -> QuerySet:
        return self._copy(df=self.df.where(F.lit(False)))

    def using(self, alias: str) -> QuerySet:
        return type(self).of(self.source, self.label, alias)

    def raw(self, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
        """SQL over the catalog's tables, each as a view named as its table."""
        for m in self.source.catalog.models.values():
            if m.table in sql:
                self.source.read(m.table, self.alias_).createOrReplaceTempView(m.table)
        return self.source.spark.sql(sql, args=params or {})

    # ---- columns --------------------------------------------------------------------------------

    def _join(self, prefix: str, f: Field) -> None:
        """Joins the model that relation field f under a prefix leads to, once."""
        path = f"{prefix}{f.name}"
        if path in self.joined:
            return
        target = self.source.catalog.models[f.target]
        right = self._table(f.target, f"{path}__")
        owner = self.source.catalog.models[self.label if not prefix else self.joined[prefix.removesuffix("__")]]
        own_key = F.col(f"{prefix}{owner.pk}") if owner.pk else None
        if f.through[0]:
            table, to_owner, to_target = f.through if not f.reverse_of else (f.through[0], f.through[2], f.through[1])
            pairs = self.source.read(table, self.alias_).select(F.col(to_owner).alias(f"{path}+a"), F.col(to_target).alias(f"{path}+b")).distinct()
            df = self.df.join(pairs, own_key == F.col(f"{path}+a"), "left")
            self.df = df.join(right, F.col(f"{path}+b") == F.col(f"{path}__{target.pk}"), "left").drop(f"{path}+a", f"{path}+b")
        elif f.reverse_of:
            self.df = self.df.join(right, own_key == F.col(f"{path}__{f.reverse_of}"), "left")
        else:
            self.df = self.df.join(right, F.col(path) == F.col(f"{path}__{target.pk}"), "left")
        self.joined[path] = f.target

    def _field_column(self, fields: list[Field]) -> Column:
        """The column of the last of fields, with joins up to its owner. The key of a forward relation is the relation's own column."""
        prefix = ""
        for i, f in enumerate(fields):
            last = i == len(fields) - 1
            if not last:
                after = fields[i + 1]
                target = self.source.catalog.models[f.target]
                if i == len(fields) - 2 and not f.reverse_of and not f.through[0] and after.column and after.column == next(x.column for x in target.fields if x.name == target.pk):
                    return F.col(f"{prefix}{f.name}")
                self._join(prefix, f)
                prefix += f"{f.name}__"
            elif f.reverse_of or f.through[0]:
                self._join(prefix, f)
                model = self.source.catalog.models[f.target]
                return F.col(f"{prefix}{f.name}__{model.pk or f.reverse_of}")
            else:
                owner = self.source.catalog.models[self.joined[prefix.removesuffix("__")] if prefix else self.label]
                name = next((x.name for x in owner.fields if x.column == f.column), f.name)
                return F.col(f"{prefix}{name}")
        raise AssertionError

    def _resolved(self, path: str, method: str) -> tuple[Column, Any]:
        r = resolve(self.source.catalog, self.label, path, method, self.virtual)
        if r.fields[0].source == "annotation":
            c, kind = F.col(r.fields[0].name), r.fields[0].kind
        else:
            c, kind = self._field_column(r.fields), r.target.kind
            if r.target.is_relation and (r.transforms or r.lookup):
                kind = r.target.kind
        for t in r.transforms:
            from quillpath.functions.lookups import TRANSFORMS

            c, kind = transform(t, c, kind), TRANSFORMS[t][0]
        if r.json_keys:
            c, kind = F.get_json_object(c, "$." + ".".join(r.json_keys)), "CharField"
        return c, (r, kind)

    def column(self, path: str) -> Column:
        """The column of a path, joined for it."""
        if self.shown is not None and path in self.df.columns and path in self.shown:
            return F.col(path)
        return self._resolved(path, "values")[0]

    def order(self, key: Any) -> Column:
        if isinstance(key, E.Order):
            return key.build(self)
        if isinstance(key, E.Expr):
            return key.build(self).asc_nulls_last()
        if key == "?":
            return F.rand()
        c = self.column(key.removeprefix("-"))
        return c.desc_nulls_last() if key.startswith("-") else c.asc_nulls_last()

    def condition(self, path: str, value: Any) -> Column:
        c, (r, kind) = self._resolved(path, "filter")
        name = r.lookup or "exact"
        if isinstance(value, QuerySet):
            marked = value.values(*([value.model.pk] if value.shown is None else value.shown)).dataframe().distinct().toDF("+in").withColumn("+hit", F.lit(True))
            key = f"+in{len(self.df.columns)}"
            self.df = self.df.join(marked.withColumnsRenamed({"+in": key, "+hit": f"{key}h"}), c == F.col(key), "left")
            return F.coalesce(F.col(f"{key}h"), F.lit(False))
        if isinstance(value, E.Expr):
            value = value.build(self)
        elif isinstance(value, (list, tuple)) and any(isinstance(v, E.Expr) for v in value):
            value = [v.build(self) if isinstance(v, E.Expr) else v for v in value]
        return predicate(name, c, value, kind)

    def subquery(self, query: QuerySet, how: str) -> Column:
        """A column of the first value, all values or the existence of query's rows that agree with this one's."""
        inner = query._copy()
        own = [c for c, _ in inner.outer]
        outer = [self.column(p) for _, p in inner.outer]
        n = len(self.df.columns)
        names = [f"+k{n}_{i}" for i in range(len(own))]
        keys = [F.col(c).alias(k) for c, k in zip(own, names, strict=True)]
        value = inner.shown[0] if inner.shown else (inner.model.pk or own[0])
        out = f"+v{n}"
        if how == "exists":
            found = inner.df.select(*keys).distinct().withColumn(out, F.lit(True)) if keys else inner.df.select(F.lit(True).alias(out)).limit(1)
        elif how == "array":
            found = inner.df.select(*keys, F.col(value).alias(out)).groupBy(*names).agg(F.array_sort(F.collect_list(out)).alias(out))
        else:
            order = [inner.order(k) for k in inner.sort] or [F.col(value).asc_nulls_last()]
            if own:
                first = inner.df.withColumn("+n", F.row_number().over(SparkWindow.partitionBy(*own).orderBy(*order))).where(F.col("+n") == 1)
            else:  # the same row for all: a top-1 of the table needs no window
                first = inner.df.orderBy(*order).limit(1)
            found = first.select(*keys, F.col(value).alias(out))
        on = F.lit(True)
        for k, o in zip(names, outer, strict=True):
            on = on & (o == F.col(k))
        self.df = self.df.join(found, on, "left").drop(*names)
        if how == "exists":
            return F.coalesce(F.col(out), F.lit(False))
        return F.coalesce(F.col(out), F.array()) if how == "array" else F.col(out)

    # ---- filters --------------------------------------------------------------------------------

    def _filtered(self, conditions: tuple[Any, ...], lookups: dict[str, Any]) -> tuple[QuerySet, Column]:
        out = self._copy()
        total = F.lit(True)
        for c in conditions:
            if isinstance(c, E.Exists) or isinstance(c, E.Q):
                total = total & c.build(out)
            else:
                raise TypeError(f"{c!r} is no condition")
        for path, value in lookups.items():
            if isinstance(value, E.OuterRef):
                c, (r, _) = out._resolved(path, "filter")
                if r.lookup not in ("", "exact"):
                    raise ValueError("a reference to the outer query is compared for equality")
                name = f"+o{len(out.df.columns)}"
                out.df = out.df.withColumn(name, c)
                out.outer = (*out.outer, (name, value.path))
            else:
                total = total & out.condition(path, value)
        return out, total

    def filter(self, *conditions: Any, **lookups: Any) -> QuerySet:
        """Rows that match all; a path over several rows keeps a row for each match."""
        out, total = self._filtered(conditions, lookups)
        return out._where(total)

    def _where(self, condition: Column) -> QuerySet:
        """Keeps rows of condition, and remembers it while nothing but conditions on the table's own rows made df."""
        whole = bool(self.local) and self.local[0] is self.df
        self.df = self.df.where(condition)
        self.local = (self.df, *self.local[1:], condition) if whole else ()
        return self

    def _own_rows(self) -> Column | None:
        """The condition that tells this query's rows from the others of its table; None where other rows or tables have a say."""
        if not self.local or self.local[0] is not self.df:
            return None
        total = F.lit(True)
        for c in self.local[1:]:
            total = total & c
        return F.coalesce(total, F.lit(False))

    def _many(self, conditions: tuple[Any, ...], lookups: dict[str, Any]) -> bool:
        paths = [*lookups, *(p for c in conditions if isinstance(c, E.Q) for p in c.paths())]
        return any(f.many for p in paths for f in resolve(self.source.catalog, self.label, p, "filter", self.virtual).fields)

    def exclude(self, *conditions: Any, **lookups: Any) -> QuerySet:
        """Rows that do not match; an unknown condition is no match. Over several rows, those of which none matches."""
        if self._many(conditions, lookups) and self.model.pk:
            found, total = type(self).of(self.source, self.label, self.alias_)._filtered(conditions, lookups)
            hit = found.df.where(total).select(F.col(self.model.pk).alias("+hit")).distinct()
            return self._copy(df=self.df.join(hit, F.col(self.model.pk) == F.col("+hit"), "left_anti"))
        out, total = self._filtered(conditions, lookups)
        return out._where(~F.coalesce(total, F.lit(False)))

    def extra(self, select: dict[str, str] | None = None, where: list[str] | None = None, order_by: list[str] | None = None) -> QuerySet:
        """SQL text over the query's columns."""
        out = self._copy()
        for name, sql in (select or {}).items():
            out.df = out.df.withColumn(name, F.expr(sql))
            out.virtual[name] = "annotation"
            out.extra_shown = (*out.extra_shown, name)
        for sql in where or []:
            out.df = out.df.where(sql)
        return out.order_by(*order_by) if order_by else out

    # ---- annotations and projections ------------------------------------------------------------

    def _annotated(self, named: dict[str, Any], visible: bool) -> QuerySet:
        out = self._copy()
        aggregates = {n: e for n, e in named.items() if isinstance(e, E.Aggregate)}
        plain = {n: e for n, e in named.items() if n not in aggregates}
        if self.grouped and aggregates:
            columns = [e.build(out).alias(n) for n, e in aggregates.items()]
            out.df = out.df.groupBy(*(F.col(c) for c in out.shown)).agg(*columns)
            out.grouped, out.joined = False, {}
        else:
            for n, e in out._related(aggregates).items():
                out.df = out.df.withColumn(n, e)
        for n, e in plain.items():
            value = e.build(out) if isinstance(e, E.Expr) or isinstance(e, E.Q) else out.column(e)
            out.df = out.df.withColumn(n, value)
        for n, e in named.items():
            out.virtual.pop(n, None)
            out.virtual[n] = getattr(e, "kind", "annotation")
        if visible:
            out.hidden = out.hidden - named.keys()
            if out.shown is not None:
                out.shown = tuple(dict.fromkeys((*out.shown, *named)))
            else:
                out.extra_shown = tuple(dict.fromkeys((*out.extra_shown, *named)))
        else:
            out.hidden = out.hidden | named.keys()
        return out

    def _related(self, aggregates: dict[str, E.Aggregate]) -> dict[str, Column]:
        """Aggregates of related rows: those of one relation are grouped by its key together, each
        relation by itself, and joined to the rows, so that no relation multiplies another's."""
        by_hop: dict[str, dict[str, E.Aggregate]] = {}
        out: dict[str, Column] = {}
        for n, e in aggregates.items():
            path = e.path.path if isinstance(e.path, E.F_) else e.path
            r = resolve(self.source.catalog, self.label, path, "annotate", self.virtual) if isinstance(path, str) and path != "*" else None
            if r and r.fields[0].many:
                by_hop.setdefault(r.fields[0].name, {})[n] = e
            elif r and any(f.many for f in r.fields):
                raise PathError("segment_not_found", path, "an aggregate begins with its relation of several rows")
            else:  # of the row itself
                value = e.value(self)
                out[n] = F.when(value.isNotNull(), 1).otherwise(0).cast("long") if isinstance(e, E.Count) else F.array(value) if isinstance(e, E.ArrayAgg) else value
        for hop, named in by_hop.items():
            f = self.source.catalog.find(self.label, hop)
            child = QuerySet.of(self.source, f.target, self.alias_)
            key = f"+g{len(self.df.columns)}"
            if f.through[0]:
                table, to_own, to_target = f.through if not f.reverse_of else (f.through[0], f.through[2], f.through[1])
                pairs = self.source.read(table, self.alias_).select(F.col(to_own).alias(key), F.col(to_target).alias("+t")).distinct()
                child.df = pairs.join(child.df, F.col("+t") == F.col(child.model.pk)).drop("+t")
            else:
                child.df = child.df.withColumn(key, F.col(f.reverse_of))
            columns = [e.below(hop).build(child).alias(n) for n, e in named.items()]
            grouped = child.df.groupBy(key).agg(*columns)
            self.df = self.df.join(grouped, F.col(self.model.pk) == F.col(key), "left").drop(key)
            for n, e in named.items():
                out[n] = F.col(n) if e.empty is None else F.coalesce(n, F.lit(e.empty))
        return out

    def annotate(self, *args: Any, **named: Any) -> QuerySet:
        """Adds columns. Unnamed aggregates are named path__aggregate. After values(), aggregates group by its columns."""
        for a in args:
            path = a.path if isinstance(a.path, str) else a.path.path
            named[f"{path}__{type(a).__name__.lower()}"] = a
        return self._annotated(named, True)

    def alias(self, **named: Any) -> QuerySet:
        """Adds names for later use that are no output."""
        return self._annotated(named, False)

    def values(self, *paths: str, **named: Any) -> QuerySet:
        out = self._annotated(named, False) if named else self._copy()
        names = list(paths) or ([] if named else list(out._visible()))
        columns: dict[str, Column] = {}
        for p in names:
            columns[p] = F.col(p) if p in out.virtual or (out.shown and p in out.shown) else out.column(p)
        for p, c in columns.items():
            out.df = out.df.withColumn(p, c)
        out.hidden = out.hidden - named.keys()
        out.shown = (*names, *named)
        out.grouped = True
        return out

    def values_list(self, *paths: str, flat: bool = False, named: bool = False) -> QuerySet:
        """As values; rows are tuples by themselves in Spark, with names either way."""
        if flat and len(paths) != 1:
            raise ValueError("flat takes one field")
        return self.values(*paths)

    def only(self, *names: str) -> QuerySet:
        keep = {self.model.pk, *(resolve(self.source.catalog, self.label, n, "only").fields[0].name for n in names)}
        return self._copy(deferred=frozenset(f.name for f in self.model.fields if f.column) - keep)

    def defer(self, *names: str) -> QuerySet:
        gone = {resolve(self.source.catalog, self.label, n, "defer").fields[0].name for n in names} - {self.model.pk}
        return self._copy(deferred=self.deferred | gone)

    def get_deferred_fields(self) -> set[str]:
        return set(self.deferred)

    def select_related(self, *paths: str) -> QuerySet:
        """Adds the fields of related models as path__field."""
        out = self._copy()
        for p in paths:
            r = resolve(out.source.catalog, out.label, p, "select_related")
            prefix = ""
            for f in r.fields:
                out._join(prefix, f)
                prefix += f"{f.name}__"
                names = tuple(prefix + x.name for x in out.source.catalog.models[f.target].fields if x.column)
                out.extra_shown = tuple(dict.fromkeys((*out.extra_shown, *names)))
        return out

    def prefetch_related(self, *paths: str | tuple[Any, ...]) -> QuerySet:
        """Adds arrays of related rows' structs, each under its relation's name; (path, query) gives the rows of query, and (path, query,
        n) the first n of them for each row, in the query's order and then by all fields. What a task has over n of a row is dropped before the shuffle."""
        out = self._copy()
        for p in paths:
            path, query, most = (*p, None, None)[:3] if isinstance(p, tuple) else (p, None, None)
            r = resolve(out.source.catalog, out.label, path, "prefetch_related")
            f = r.fields[0]
            child = query._copy() if query is not None else QuerySet.of(out.source, f.target, out.alias_)
            names = [x.name for x in child.model.fields if x.column]
            order = [child.order(k) for k in child.sort] + [F.col(n).asc_nulls_last() for n in names] if most is not None else []
            row = F.struct(*names).alias("+row")
            key = f"+p{len(out.df.columns)}"

            def some(df: DataFrame, by: Column, order: list[Column] = order, most: int | None = most) -> DataFrame:
                if most is None:
                    return df
                return df.withColumn("+n", F.row_number().over(SparkWindow.partitionBy(by).orderBy(*order))).where(F.col("+n") <= most)

            if f.through[0]:
                table, to_own, to_target = f.through if not f.reverse_of else (f.through[0], f.through[2], f.through[1])
                pairs = out.source.read(table, out.alias_).select(F.col(to_own).alias(key), F.col(to_target).alias("+t")).distinct()
                rows = some(pairs.join(child.df, F.col("+t") == F.col(child.model.pk)), F.col(key)).select(key, row)
                own = F.col(out.model.pk)
            elif f.reverse_of:
                rows, own = some(child.df, F.col(f.reverse_of)).select(F.col(f.reverse_of).alias(key), row), F.col(out.model.pk)
            else:
                rows, own = child.df.select(F.col(child.model.pk).alias(key), row), F.col(f.name)
            arrays = rows.groupBy(key).agg(F.array_sort(F.collect_list("+row")).alias(f"{f.name}_rows"))
            out.df = out.df.join(arrays, own == F.col(key), "left").drop(key).withColumn(f"{f.name}_rows", F.coalesce(f"{f.name}_rows", F.array()))
            out.extra_shown = (*out.extra_shown, f"{f.name}_rows")
        return out

    # ---- order, slices, duplicates --------------------------------------------------------------

    def order_by(self, *keys: Any) -> QuerySet:
        out = self._copy(sort=keys)
        for k in keys:
            out.order(k)  # joins what the keys need, and finds mistakes now
        return out

    def reverse(self) -> QuerySet:
        def flip(k: Any) -> Any:
            if isinstance(k, E.Order):
                return E.Order(k.expr, not k.descending)
            if isinstance(k, E.Expr):
                return E.Order(k, True)
            return k[1:] if k.startswith("-") else f"-{k}"

        return self._copy(sort=tuple(map(flip, self.sort or ((self.model.pk,) if self.model.pk else ()))))

    def _sorted(self) -> QuerySet:
        out = self._copy()
        if out.sort:
            out.df = out.df.orderBy(*(out.order(k) for k in out.sort))
        return out

    def __getitem__(self, at: slice | int) -> QuerySet:
        if isinstance(at, int):
            at = slice(at, at + 1)
        if self.outer:  # one row for each outer row, taken where the subquery is joined
            if (at.start or 0, at.stop) != (0, 1):
                raise ValueError("a correlated subquery takes its first row")
            return self._copy()
        out = self._sorted()
        if at.start:
            out.df = out.df.offset(at.start)
        if at.stop is not None:
            out.df = out.df.limit(at.stop - (at.start or 0))
        return out

    def distinct(self, *paths: str) -> QuerySet:
        """Without paths, different output rows; with them, the first row in order of each combination."""
        out = self._copy()
        if not paths:
            if out.shown is None and not out.extra_shown and out.model.pk:
                # rows of one key are equal in every output column
                out.df = out.df.dropDuplicates([out.model.pk])
            else:
                out.df = out.df.dropDuplicates(list(out._visible()))
            return out
        keys = [out.column(p) for p in paths]
        order = [out.order(k) for k in out.sort] or [F.col(c) for c in out._visible()]
        out.df = out.df.withColumn("+n", F.row_number().over(SparkWindow.partitionBy(*keys).orderBy(*order))).where(F.col("+n") == 1).drop("+n")
        return out

    def _dates(self, path: str, kind: str, order: str, cast: str) -> QuerySet:
        out = self._copy()
        c = F.date_trunc(kind, out.column(path)).cast(cast)
        name = "datefield"
        out.df = out.df.where(c.isNotNull()).select(c.alias(name)).distinct()
        out.joined, out.shown, out.virtual = {}, (name,), {name: "DateTimeField"}
        return out.order_by(name if order == "ASC" else f"-{name}")

    def dates(self, path: str, kind: str, order: str = "ASC") -> QuerySet:
        return self._dates(path, kind, order, "date")

    def datetimes(self, path: str, kind: str, order: str = "ASC") -> QuerySet:
        return self._dates(path, kind, order, "timestamp_ntz")

    # ---- sets -----------------------------------------------------------------------------------

    def _set(self, frames: DataFrame) -> QuerySet:
        return self._copy(df=frames, joined={}, shown=tuple(frames.columns), virtual=dict.fromkeys(frames.columns, "annotation"), sort=(), grouped=False)

    def union(self, *others: QuerySet, all: bool = False) -> QuerySet:  # noqa: A002
        df = self.dataframe()
        for o in others:
            df = df.union(o.dataframe())
        return self._set(df if all else df.distinct())

    def intersection(self, *others: QuerySet) -> QuerySet:
        df = self.dataframe()
        for o in others:
            df = df.intersect(o.dataframe())
        return self._set(df)

    def difference(self, *others: QuerySet) -> QuerySet:
        df = self.dataframe()
        for o in others:
            df = df.subtract(o.dataframe())
        return self._set(df)

    # ---- results --------------------------------------------------------------------------------

    def _visible(self) -> tuple[str, ...]:
        if self.shown is not None:
            return self.shown
        own = tuple(f.name for f in self.model.fields if f.column and f.name not in self.deferred)
        return tuple(c for c in dict.fromkeys((*own, *self.extra_shown)) if c not in self.hidden)

    def dataframe(self) -> DataFrame:
        """The output as a DataFrame; nothing has run yet."""
        out = self._sorted()
        return out.df.select(*(F.col(c) for c in out._visible()))

    def iterator(self, chunk_size: int | None = None) -> Iterator[Row]:
        """Rows in order. With chunk_size the driver holds a few chunks at a time, see chunks; without, a partition of the result."""
        if chunk_size is None:
            return self.dataframe().toLocalIterator(prefetchPartitions=True)
        return (row for chunk in self.chunks(chunk_size) for row in chunk)

    def chunks(self, size: int) -> Iterator[list[Row]]:
        """Lists of `size` rows in order, the last one shorter. The result is sorted and written once with row numbers; a job reads a chunk by them,
        or as many whole ones as READ_BYTES of the files hold, so neither the driver nor a job depends on how large a partition is."""
        if size < 1:
            raise ValueError("a chunk has rows")
        return _chunks(numbered(self.dataframe()), size)

    def paged(self, size: int) -> DataFrame:
        """The rows with page, the number of the chunk of `size` rows that each is in, and number, its own among all, both from 0 in the query's order.
        Rows and pages stay in Spark."""
        if size < 1:
            raise ValueError("a page has rows")
        return numbered(self.dataframe()).rows().withColumns({"page": F.expr(f"`{NUMBER}` div {size}"), "number": F.col(NUMBER)}).drop(NUMBER)

    def __iter__(self) -> Iterator[Row]:
        return self.iterator()

    def count(self) -> int:
        return self.dataframe().count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def contains(self, row: Any) -> bool:
        key = row[self.model.pk] if isinstance(row, (Row, dict)) else row
        return self.filter(**{self.model.pk: key}).exists()

    def aggregates(self, *args: E.Aggregate, **named: E.Aggregate) -> DataFrame:
        """One row of aggregates, as a DataFrame."""
        for a in args:
            named[f"{a.path}__{type(a).__name__.lower()}"] = a
        out = self._copy()
        columns = [e.build(out).alias(n) for n, e in named.items()]
        return out.df.agg(*columns)

    def aggregate(self, *args: E.Aggregate, **named: E.Aggregate) -> dict[str, Any]:
        return self.aggregates(*args, **named).first().asDict()

    def get(self, *conditions: Any, **lookups: Any) -> Row:
        rows = self.filter(*conditions, **lookups).dataframe().limit(2).collect()
        if not rows:
            raise DoesNotExist(self.label)
        if len(rows) > 1:
            raise MultipleObjectsReturned(self.label)
        return rows[0]

    def _ordered(self, keys: tuple[Any, ...]) -> QuerySet:
        return self.order_by(*(keys or self.sort or ((self.model.pk,) if self.model.pk else ())))

    def first(self) -> Row | None:
        return self._ordered(())[:1].dataframe().first()

    def last(self) -> Row | None:
        return self._ordered(()).reverse()[:1].dataframe().first()

    def earliest(self, *paths: str) -> QuerySet:
        return self.order_by(*paths)[:1]

    def latest(self, *paths: str) -> QuerySet:
        return self.order_by(*paths).reverse()[:1]

    def in_bulk(self, ids: list[Any], field_name: str = "pk") -> dict[Any, Row]:
        name = self.model.pk if field_name == "pk" else field_name
        return {r[name]: r for r in self.filter(**{f"{name}__in": ids}).dataframe().collect()}

    def explain(self, mode: str = "formatted") -> str:
        return self.dataframe()._jdf.queryExecution().explainString(self.source.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def select_for_update(self, nowait: bool = False, skip_locked: bool = False, of: tuple[str, ...] = (), no_key: bool = False) -> QuerySet:
        """Files have no row locks; the query is unchanged."""
        import warnings

        warnings.warn("row locks have no meaning here", stacklevel=2)
        return self._copy()

    # ---- writes: each gives the whole table as it would be -----------------------------------------

    def _whole(self) -> DataFrame:
        return self._table(self.label, "")

    def _rows(self, rows: list[dict[str, Any]] | DataFrame) -> DataFrame:
        whole = self._whole()
        if isinstance(rows, DataFrame):
            return rows.select(*(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in whole.dtypes))
        for row in rows:
            for name in row:
                direct(self.source.catalog, self.label, name)
        return self.source.spark.createDataFrame([tuple(r.get(c) for c in whole.columns) for r in rows], whole.schema)

    def create(self, **row: Any) -> DataFrame:
        return self.bulk_create([row])

    def bulk_create(self, rows: list[dict[str, Any]] | DataFrame, batch_size: int | None = None, ignore_conflicts: bool = False, update_conflicts: bool = False, update_fields: tuple[str, ...] = (), unique_fields: tuple[str, ...] = ()) -> DataFrame:
        """The table with rows; of rows with equal keys the old stay, or take update_fields from the new."""
        whole, new = self._whole(), self._rows(rows)
        keys = list(unique_fields) or [self.model.pk]
        if update_conflicts:
            changed = self.bulk_update(new, list(update_fields), keys)
            return changed.unionByName(new.join(whole, keys, "left_anti"))
        return whole.unionByName(new.join(whole, keys, "left_anti") if ignore_conflicts else new)

    def update(self, **values: Any) -> DataFrame:
        """The table with values in the rows of this query: one pass where conditions are on the row itself, else by a join on the key."""
        for name in values:
            direct(self.source.catalog, self.label, name)
        q = QuerySet.of(self.source, self.label, self.alias_)
        hit = self._own_rows()
        if hit is None:
            if not self.model.pk:
                raise ValueError(f"{self.label} has no key to update by")
            found = self.df.select(F.col(self.model.pk).alias("+hit")).distinct()
            q.df = q.df.join(found, F.col(self.model.pk) == F.col("+hit"), "left")
            hit = F.col("+hit").isNotNull()
        new = {n: F.when(hit, v.build(q) if isinstance(v, E.Expr) else F.lit(v)).otherwise(F.col(n)) for n, v in values.items()}
        return q.df.select(*(new.get(c, F.col(c)).alias(c) for c in self._whole().columns))

    def bulk_update(self, rows: list[dict[str, Any]] | DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
        for name in fields:
            direct(self.source.catalog, self.label, name)
        whole, new = self._whole(), self._rows(rows)
        keys = keys or [self.model.pk]
        if new.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError("several new rows have one key")
        new = new.select(*keys, *(F.col(c).alias(f"+{c}") for c in fields), F.lit(True).alias("+hit"))
        return whole.join(new, keys, "left").select(*(F.when(F.col("+hit"), F.col(f"+{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in whole.columns))

    def delete(self) -> DataFrame:
        """The table without the rows of this query, as update finds them; related tables are not touched."""
        own = self._own_rows()
        if own is not None:
            return self._whole().where(~own)
        if not self.model.pk:
            raise ValueError(f"{self.label} has no key to delete by")
        hit = self.df.select(F.col(self.model.pk).alias("+hit")).distinct()
        return self._whole().join(hit, F.col(self.model.pk) == F.col("+hit"), "left_anti")

    # ---- writes that are commits: each gives the number of the new version of a table in source.versioned ----

    def _target(self) -> tuple[VersionedTable, dict[str, str]]:
        """The versioned table of the model, and the columns of its fields."""
        if self.model.table not in self.source.versioned:
            raise ValueError(f"{self.model.table} is no versioned table")
        return self.source.versioned[self.model.table], {f.name: f.column for f in self.model.fields if f.column}

    def _found(self) -> Column | DataFrame:
        """What tells this query's rows: a condition on single rows, or else their keys."""
        own = self._own_rows()
        if own is not None:
            return own
        if not self.model.pk:
            raise ValueError(f"{self.label} has no key to write by")
        return self.df.select(self.model.pk).distinct()

    def update_rows(self, **values: Any) -> int:
        """Values in the rows of this query; only files that hold one of them are rewritten."""
        table, columns = self._target()
        for name in values:
            direct(self.source.catalog, self.label, name)
        q = QuerySet.of(self.source, self.label, self.alias_)
        return table.update(self._found(), {columns[n]: v.build(q) if isinstance(v, E.Expr) else F.lit(v) for n, v in values.items()}, columns)

    def delete_rows(self) -> int:
        """Removes the rows of this query; related tables are not touched."""
        table, columns = self._target()
        return table.delete(self._found(), columns)

    def create_rows(self, rows: list[dict[str, Any]] | DataFrame, update_fields: tuple[str, ...] = (), ignore_conflicts: bool = False) -> int:
        """Adds rows. Of rows with equal keys the old stay with ignore_conflicts, or take update_fields from the new."""
        table, columns = self._target()
        new = self._rows(rows)
        if ignore_conflicts:
            new = new.join(self._whole(), [self.model.pk], "left_anti")
        if not update_fields:
            renamed = new.withColumnsRenamed(columns)
            missing = [f for f in table.version().schema if f.name not in renamed.columns]
            return table.append(renamed.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))
        key = columns[self.model.pk]
        return table.merge(new, [key], update=[columns[f] for f in update_fields], names=columns)

    def _given(self, row: Row | dict[str, Any]) -> tuple[dict[str, Any], Any]:
        """The fields that a row has, and its key."""
        if not self.model.pk or self.model.table not in self.source.versioned:
            raise NotImplementedError(f"rows of {self.label} are not saved one by one: it needs a key and a versioned table")
        values = row.asDict() if isinstance(row, Row) else dict(row)
        for name in values:
            direct(self.source.catalog, self.label, name)
        if values.get(self.model.pk) is None:
            raise ValueError(f"a row of {self.label} needs its key {self.model.pk}")
        return values, values[self.model.pk]

    def save(self, row: Row | dict[str, Any], force_insert: bool = False, force_update: bool = False, update_fields: tuple[str, ...] | None = None) -> int:
        """Writes one row by its key, only the fields that it has (or update_fields), as a commit that rewrites the one file that holds it, or
        adds one. Many rows go better together, by create_rows and update_rows."""
        values, key = self._given(row)
        table, columns = self._target()
        if update_fields is not None:
            values = {n: v for n, v in values.items() if n in update_fields or n == self.model.pk}
        there = table.read().where(F.col(columns[self.model.pk]) == F.lit(key)).limit(1).count() == 1
        if force_insert and there:
            raise ValueError(f"{self.label} has a row {key}")
        if (force_update or update_fields is not None) and not there:
            raise DoesNotExist(f"{self.label} {key}")
        kinds = {f.name: f.dataType for f in table.version().schema}
        schema = StructType([StructField(n, kinds[columns[n]]) for n in values])
        return table.merge(self.source.spark.createDataFrame([tuple(values.values())], schema), [columns[self.model.pk]], names=columns)

    def remove(self, row: Row | dict[str, Any]) -> int:
        """Removes the row with this row's key."""
        _, key = self._given(row)
        table, columns = self._target()
        return table.delete(F.col(columns[self.model.pk]) == F.lit(key))

    def refresh_from_db(self, row: Row | dict[str, Any], fields: tuple[str, ...] | None = None) -> Row:
        """The row of the newest version with this row's key; with fields, the row with these alone as they are there."""
        values, key = self._given(row)
        now = type(self).of(self.source, self.label, self.alias_).get(**{self.model.pk: key})
        return now if fields is None else Row(**{**values, **{f: now[f] for f in fields}})

    def _matches(self, lookups: dict[str, Any]) -> int:
        """0 or 1 rows that lookups find; several are an error, as for get."""
        n = self.filter(**lookups).df.limit(2).count()
        if n > 1:
            raise ValueError(f"several rows of {self.label} match")
        return n

    def get_or_create(self, defaults: dict[str, Any] | None = None, **lookups: Any) -> tuple[DataFrame, bool]:
        """The table, and whether a row was added to it."""
        if self._matches(lookups):
            return self._whole(), False
        return self.create(**{k: v for k, v in lookups.items() if "__" not in k}, **(defaults or {})), True

    def update_or_create(self, defaults: dict[str, Any] | None = None, create_defaults: dict[str, Any] | None = None, **lookups: Any) -> tuple[DataFrame, bool]:
        if self._matches(lookups):
            return self.filter(**lookups).update(**(defaults or {})), False
        return self.create(**{k: v for k, v in lookups.items() if "__" not in k}, **(create_defaults or defaults or {})), True

    # ---- checks -----------------------------------------------------------------------------------

    def violations(self, check: E.Q) -> QuerySet:
        """Rows for which a check constraint is false."""
        out, total = self._filtered((check,), {})
        out.df = out.df.where(~F.coalesce(total, F.lit(True)))
        return out

    def duplicates(self, *names: str, condition: E.Q | None = None) -> DataFrame:
        """Combinations of fields that several rows (of the condition) have, and how many."""
        q = self.filter(condition) if condition is not None else self._copy()
        return q.df.groupBy(*(direct(q.source.catalog, q.label, n).name for n in names)).agg(F.count("*").alias("n")).where("n > 1")

    def full_clean(self, checks: tuple[E.Q, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> dict[str, int]:
        """How many rows break each check, and how many combinations each uniqueness."""
        out = {f"check_{i}": self.violations(c).count() for i, c in enumerate(checks)}
        return out | {"unique_" + "_".join(u): self.duplicates(*u).count() for u in unique}

    clean = clean_fields = validate_unique = validate_constraints = full_clean


def _chunks(made: Numbered, size: int) -> Iterator[list[Row]]:
    step = size * max(1, int(READ_BYTES / (size * made.width))) if made.count else size
    for low in range(0, made.count, step):
        rows = made.between(low, low + step).collect()
        yield from (rows[i : i + size] for i in range(0, len(rows), size))


def _asynchronous(name: str) -> Callable[..., Any]:
    async def run(self: QuerySet, *args: Any, **kw: Any) -> Any:
        return await asyncio.to_thread(getattr(self, name), *args, **kw)

    run.__name__ = f"a{name}"
    run.__doc__ = f"{name} in a thread."
    return run


for _name in ("iterator", "count", "exists", "first", "last", "get", "create", "get_or_create", "update_or_create", "bulk_create", "bulk_update", "update", "delete", "latest", "earliest", "in_bulk", "contains", "aggregate", "clean", "full_clean", "save", "remove", "refresh_from_db"):
    setattr(QuerySet, f"a{_name}", _asynchronous(_name))
