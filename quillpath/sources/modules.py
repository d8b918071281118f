"""Python modules as rows: what their syntax trees declare."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """path string, module string, is_package boolean, error string, explicit_all array<string>,
symbols array<struct<symbol:string,line:int,col:int>>,
imports array<struct<source:string,symbol:string,alias:string,is_star:boolean,ordinal:int>>,
classes array<struct<name:string,bases:array<string>,is_abstract:boolean,app_label:string,line:int,col:int>>,
fields array<struct<class:string,name:string,call:string,target_kind:string,target:string,related_name:string,related_query_name:string,line:int,ordinal:int>>,
methods array<struct<class:string,name:string,decorator:string,returns:string,line:int>>,
aliases array<struct<name:string,value:string>>"""


def module_name(path: str) -> tuple[str, bool]:
    parts = path.removesuffix(".py").split("/")
    package = parts[-1] == "__init__"
    return ".".join(parts[:-1] if package else parts), package


def absolute(module: str, package: bool, level: int, source: str) -> str:
    """The module that a relative import of `level` dots names, seen from module."""
    if not level:
        return source
    parts = module.split(".")
    base = parts[: len(parts) - level + (1 if package else 0)]
    return ".".join([*base, source] if source else base)


def _dotted(node: ast.AST | None) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, (ast.Subscript, ast.Call)):
        return _dotted(node.value if isinstance(node, ast.Subscript) else node.func)
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""


def _top(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Statements of a module; blocks under TYPE_CHECKING belong to it, other blocks do not."""
    for node in body:
        if isinstance(node, ast.If) and _dotted(node.test).endswith("TYPE_CHECKING"):
            yield from _top(node.body)
        else:
            yield node


def parse(path: str, text: str) -> dict:
    """One row of SCHEMA; a text that is no Python has only an error."""
    module, package = module_name(path)
    row: dict = {"path": path, "module": module, "is_package": package, "error": None, "explicit_all": None}
    row |= {k: [] for k in ("symbols", "imports", "classes", "fields", "methods", "aliases")}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return row | {"error": str(e)}
    texts: dict[str, str] = {}
    for node in _top(tree.body):
        if isinstance(node, ast.Import):
            for a in node.names:
                row["imports"].append({"source": a.name if a.asname else a.name.split(".")[0], "symbol": "", "alias": a.asname or a.name.split(".")[0], "is_star": False, "ordinal": len(row["imports"])})
        elif isinstance(node, ast.ImportFrom):
            source = absolute(module, package, node.level, node.module or "")
            for a in node.names:
                row["imports"].append({"source": source, "symbol": "" if a.name == "*" else a.name, "alias": "" if a.name == "*" else a.asname or a.name, "is_star": a.name == "*", "ordinal": len(row["imports"])})
        elif isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            row["symbols"].append({"symbol": node.name, "line": node.lineno, "col": node.col_offset})
            if isinstance(node, ast.ClassDef):
                _class(node, row, texts)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if not isinstance(target, ast.Name):
                    continue
                if target.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                    row["explicit_all"] = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
                    continue
                row["symbols"].append({"symbol": target.id, "line": node.lineno, "col": node.col_offset})
                if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                    texts[target.id] = node.value.value
                elif isinstance(node.value, (ast.Name, ast.Attribute)):
                    row["aliases"].append({"name": target.id, "value": _dotted(node.value)})
    return row


def _class(node: ast.ClassDef, row: dict, texts: dict[str, str]) -> None:
    made = {"name": node.name, "bases": [b for b in map(_dotted, node.bases) if b], "is_abstract": False, "app_label": None, "line": node.lineno, "col": node.col_offset}
    for s in node.body:
        if isinstance(s, ast.ClassDef) and s.name == "Meta":
            for m in s.body:
                if isinstance(m, ast.Assign) and isinstance(m.value, ast.Constant):
                    for t in m.targets:
                        if isinstance(t, ast.Name) and t.id == "abstract":
                            made["is_abstract"] = bool(m.value.value)
                        elif isinstance(t, ast.Name) and t.id == "app_label":
                            made["app_label"] = str(m.value.value)
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            marks = [_dotted(d).rpartition(".")[2] for d in s.decorator_list]
            row["methods"].append({"class": node.name, "name": s.name, "decorator": marks[0] if marks else "", "returns": ast.unparse(s.returns) if s.returns else "", "line": s.lineno})
        elif isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(s.value, ast.Call):
            words = {k.arg: k.value for k in s.value.keywords if k.arg}
            first = s.value.args[0] if s.value.args else words.get("to")
            kind = "string" if isinstance(first, ast.Constant) and isinstance(first.value, str) else "symbol" if _dotted(first) else ""

            def text(name: str, words: dict = words) -> str:
                v = words.get(name)
                return v.value if isinstance(v, ast.Constant) and isinstance(v.value, str) else texts.get(v.id, "") if isinstance(v, ast.Name) else ""

            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                if isinstance(t, ast.Name):
                    row["fields"].append({"class": node.name, "name": t.id, "call": _dotted(s.value.func), "target_kind": kind, "target": _dotted(first), "related_name": text("related_name"), "related_query_name": text("related_query_name"), "line": s.lineno, "ordinal": len(row["fields"])})
    row["classes"].append(made)


def read_modules(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, text). Where a package and a file beside it have one module name, the package stands."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse(p, t or "") for p, t in zip(f["path"], f["text"], strict=True)], columns=[c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")])

    parsed = files.select("path", "text").mapInPandas(rows, SCHEMA)
    pick = parsed.groupBy("module").agg(F.max_by("path", F.struct("is_package", "path")).alias("path"))
    return parsed.join(pick, ["module", "path"], "left_semi")
