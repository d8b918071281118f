"""Where Python source names fields: lookup paths, direct fields, schema fields and relation strings, each with its receiver."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpath.plans import metadata, surface
from quillpath.plans.paths import FILTERS, RELATION_ONLY
from quillpath.sources.modules import _dotted, module_name

USAGES = "module string, path string, line int, col int, context string, method string, value string, ref string, receiver string, names array<string>"
# Methods by what their arguments name.
PATH_STRINGS = frozenset({"values", "values_list", "only", "defer", "order_by", "distinct", "dates", "datetimes", "latest", "earliest"})
FIRST_STRING = frozenset({"dates", "datetimes"})
DIRECT_KEYWORDS = frozenset({"create", "update", "acreate", "aupdate"})
RELATION_FIELDS = frozenset({"ForeignKey", "OneToOneField", "ManyToManyField"})
SCHEMA_LISTS = frozenset({"ordering", "unique_together", "index_together"})
SCHEMA_CALLS = frozenset({"UniqueConstraint", "Index", "CheckConstraint"})
OTHER_KEYWORDS = frozenset({"defaults", "create_defaults", "flat", "named", "output_field", "filter", "default", "distinct", "ordering", "condition"})


def _strings(node: ast.AST | None) -> Iterator[ast.Constant]:
    """The texts of a constant or of a list or tuple of constants, nested ones too."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        yield node
    elif isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        for e in node.elts:
            yield from _strings(e)


class _Walk(ast.NodeVisitor):
    """Collects usages of one module. env has what names stand for: (class reference, receiver kind, member names after it)."""

    def __init__(self, path: str):
        self.path, self.module = path, module_name(path)[0]
        self.env: dict[str, tuple[str, str, list[str]]] = {}
        self.owner: list[str] = []
        self.rows: list[tuple] = []

    def add(self, node: ast.AST, context: str, method: str, value: str, at: tuple[str, str, list[str]] | None) -> None:
        ref, receiver, names = at or ("", "", [])
        self.rows.append((self.module, self.path, node.lineno, node.col_offset, context, method, value, ref, receiver, list(names)))

    # ---- receivers: assignments, loops, annotations, self, and class names as they are written

    def receiver(self, node: ast.AST) -> tuple[str, str, list[str]] | None:
        if isinstance(node, ast.Name):
            if node.id in self.env:
                return self.env[node.id]
            if node.id in ("self", "cls") and self.owner:
                return self.owner[-1], "instance" if node.id == "self" else "model_class", []
            if node.id[:1].isupper():
                return node.id, "model_class", []
            pascal = "".join(p.capitalize() for p in node.id.split("_"))
            return pascal, "instance", []
        if isinstance(node, ast.Attribute):
            base = self.receiver(node.value)
            if base and base[1] == "instance" and not base[2] and isinstance(node.value, ast.Name) and node.value.id not in self.env and node.value.id not in ("self", "cls"):
                dotted = _dotted(node)  # a class of a module that is named in full
                if node.attr[:1].isupper():
                    return dotted, "model_class", []
            return (base[0], base[1], [*base[2], node.attr]) if base else None
        if isinstance(node, ast.Call):
            got = self.receiver(node.func)
            return (got[0], "instance", []) if got and got[1] == "model_class" and not got[2] and isinstance(node.func, (ast.Name, ast.Attribute)) else got
        if isinstance(node, ast.Subscript):
            got = self.receiver(node.value)
            return got if isinstance(node.slice, ast.Slice) or not got else (got[0], got[1], [*got[2], "first"])
        return self.receiver(node.value) if isinstance(node, ast.Await) else None

    def bind(self, target: ast.AST, value: tuple[str, str, list[str]] | None) -> None:
        if isinstance(target, ast.Name):
            if value:
                self.env[target.id] = value
            else:
                self.env.pop(target.id, None)

    def each(self, node: ast.AST) -> tuple[str, str, list[str]] | None:
        """One row of what a loop goes over."""
        got = self.receiver(node)
        return (got[0], got[1], [*got[2], "first"]) if got else None

    def visit_Assign(self, node: ast.Assign) -> None:
        self.generic_visit(node)
        for t in node.targets:
            self.bind(t, self.receiver(node.value) if isinstance(node.value, (ast.Call, ast.Attribute, ast.Name, ast.Subscript, ast.Await)) else None)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.generic_visit(node)
        self.bind(node.target, self.annotated(node.annotation))

    def visit_For(self, node: ast.For) -> None:
        self.bind(node.target, self.each(node.iter))
        self.generic_visit(node)

    visit_AsyncFor = visit_For

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.bind(node.target, self.each(node.iter))
        self.generic_visit(node)

    def _comprehension(self, node: ast.AST) -> None:
        kept = dict(self.env)
        for g in node.generators:
            self.visit(g)
        for field in ("elt", "key", "value"):
            if (inner := getattr(node, field, None)) is not None:
                self.visit(inner)
        self.env = kept

    visit_ListComp = visit_SetComp = visit_GeneratorExp = visit_DictComp = _comprehension

    def annotated(self, node: ast.AST | None) -> tuple[str, str, list[str]] | None:
        name = _dotted(node)
        if name.rpartition(".")[2] == "QuerySet" and isinstance(node, ast.Subscript):
            return _dotted(node.slice), "queryset", []
        return (name, "instance", []) if name and name.rpartition(".")[2][:1].isupper() else None

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kept = dict(self.env)
        for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
            if a.annotation is not None:
                self.bind(ast.Name(a.arg), self.annotated(a.annotation))
        self.generic_visit(node)
        self.env = kept

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if node.name == "Meta" and self.owner:
            self.schema(node)
            return
        kept, self.env = self.env, dict(self.env)
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()
        self.env = kept

    # ---- usages

    def schema(self, node: ast.ClassDef) -> None:
        at = (self.owner[-1], "model_class", [])
        for s in node.body:
            if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id in SCHEMA_LISTS for t in s.targets):
                for c in _strings(s.value):
                    self.add(c, "schema", "ordering" if c.value.startswith("-") else s.targets[0].id, c.value, at)
            for call in (c for c in ast.walk(s) if isinstance(c, ast.Call)):
                name = _dotted(call.func).rpartition(".")[2]
                if name in SCHEMA_CALLS:
                    for k in call.keywords:
                        if k.arg in ("fields", "include"):
                            for c in _strings(k.value):
                                self.add(c, "schema", name, c.value, at)
                        elif k.arg in ("condition", "check"):
                            self.expressions(k.value, at, "filter")

    def expressions(self, node: ast.AST, at: tuple[str, str, list[str]] | None, method: str) -> None:
        """Paths inside Q, F, Prefetch and expressions of an argument."""
        if not isinstance(node, ast.Call):
            for child in ast.iter_child_nodes(node):
                self.expressions(child, at, method)
            return
        name = _dotted(node.func).rpartition(".")[2]
        if isinstance(node.func, ast.Attribute) and name not in ("Q", "F", "Prefetch") and not name[:1].isupper():
            return  # a query of its own
        for k in node.keywords:
            if name == "Q" and k.arg:
                self.add(k, "lookup", "filter", k.arg, at)
            elif name in ("Q", "When") and k.arg is None:
                self.keys(k.value, "lookup", "filter", at)
            elif name == "When" and k.arg not in ("then", "condition"):
                self.add(k, "lookup", "filter", k.arg or "", at)
            self.expressions(k.value, at, method)
        for i, a in enumerate(node.args):
            if i == 0 and isinstance(a, ast.Constant) and isinstance(a.value, str) and name not in ("Value", "Q", "Subquery", "Exists"):
                outer = name == "OuterRef"
                self.add(a, "relation" if name == "Prefetch" else "outer" if outer else "lookup", "prefetch_related" if name == "Prefetch" else "values", a.value, at)
            self.expressions(a, at, method)

    def keys(self, node: ast.AST, context: str, method: str, at: tuple[str, str, list[str]] | None) -> None:
        if isinstance(node, ast.Dict):
            for k in node.keys:
                if isinstance(k, ast.Constant) and isinstance(k.value, str):
                    self.add(k, context, method, k.value, at)

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func).rpartition(".")[2]
        if name in RELATION_FIELDS and node.args:
            for c in _strings(node.args[0]):
                self.add(c, "relation_target", name, c.value, (self.owner[-1], "model_class", []) if self.owner else None)
        if isinstance(node.func, ast.Attribute):
            method, at = node.func.attr, self.receiver(node.func.value)
            if at and (at[2] or at[1] != "model_class"):
                self.method(node, method, at)
        self.generic_visit(node)

    def method(self, node: ast.Call, method: str, at: tuple[str, str, list[str]]) -> None:
        filters, direct = method in FILTERS, method in DIRECT_KEYWORDS
        if not (filters or direct or method in PATH_STRINGS or method in RELATION_ONLY or method in ("annotate", "alias", "aggregate", "bulk_update", "abulk_update", "in_bulk")):
            return
        for k in node.keywords:
            if k.arg is None:
                self.keys(k.value, "lookup" if filters else "direct", method, at)
            elif k.arg in ("defaults", "create_defaults"):
                self.keys(k.value, "direct", "create", at)
            elif method == "in_bulk" and k.arg == "field_name":
                for c in _strings(k.value):
                    self.add(c, "direct", method, c.value, at)
            elif method in ("bulk_update", "abulk_update") and k.arg == "fields":
                for c in _strings(k.value):
                    self.add(c, "direct", "bulk_update", c.value, at)
            elif filters and k.arg not in OTHER_KEYWORDS or direct:
                self.add(k, "lookup" if filters else "direct", method, k.arg, at)
            self.expressions(k.value, at, method)
        if method in ("bulk_update", "abulk_update") and len(node.args) > 1:
            for c in _strings(node.args[1]):
                self.add(c, "direct", "bulk_update", c.value, at)
        for i, a in enumerate(node.args):
            if isinstance(a, ast.Constant) and isinstance(a.value, str) and (method in RELATION_ONLY or method in PATH_STRINGS) and (i == 0 or method not in FIRST_STRING):
                self.add(a, "relation" if method in RELATION_ONLY else "lookup", method, a.value, at)
            else:
                self.expressions(a, at, method)


def usages_of(path: str, text: str) -> list[tuple]:
    """Rows of USAGES; a text that is no Python has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    walk = _Walk(path)
    walk.visit(tree)
    return walk.rows


def read_usages(files: DataFrame) -> DataFrame:
    """Rows of USAGES of all files (path, text): the field names and paths that the source has as texts or keywords.

    context is lookup, direct, schema, relation, relation_target or outer. ref and receiver are the class that
    the receiver comes from and what of it, names the members from there on; a receiver that is not seen is empty.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"], strict=True) for r in usages_of(p, t or "")], columns=[c.split()[0] for c in USAGES.split(", ")])

    return files.select("path", "text").mapInPandas(rows, USAGES)


def located(usages: DataFrame, made: metadata.Metadata, members: DataFrame) -> DataFrame:
    """usages with id and model: the class of the receiver by the names of its module, else by a unique object name,
    then along its members. model is null where that leads nowhere. A schema's or relation's model is the class itself."""
    u = metadata.stored(usages.withColumn("id", F.xxhash64("path", "line", "col", "context", "value")))
    refs = u.where("ref <> ''").select("module", "ref").distinct()
    origin = made.models.select(F.col("module").alias("origin_module"), F.col("name").alias("origin_symbol"), F.col("label").alias("_label"))
    unique = metadata.object_names(made.models).where("label is not null").select(F.col("name").alias("_short"), F.col("label").alias("_only"))
    classes = metadata._reference(refs, made.modules, made.exports).join(origin, ["origin_module", "origin_symbol"], "left")
    classes = classes.withColumn("_short", F.substring_index("ref", ".", -1)).join(unique, "_short", "left").select("module", "ref", F.coalesce("_label", "_only").alias("class"))
    u = metadata.stored(u.join(classes.dropDuplicates(["module", "ref"]), ["module", "ref"], "left"))
    starts = u.where("class is not null").select("id", F.col("class").alias("model"), "receiver", "names").dropDuplicates(["id"])
    ends = surface.chain(members, starts).select("id", F.when(F.col("receiver").isNotNull(), F.col("model")).alias("model"))
    return u.join(ends, "id", "left")
