"""Resolution of double-underscore paths against a catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from quillpath.functions.lookups import TRANSFORMS, base_kind, lookups_of, transforms_of
from quillpath.plans.catalog import Catalog, Field

# What each method takes as a path.
RELATION_ONLY = frozenset({"select_related", "prefetch_related"})
ATTRIBUTE_PATH = frozenset({"select_related", "prefetch_related", "only", "defer"})
#: Methods whose paths may end in transforms.
TRANSFORMING = frozenset({"order_by", "values", "annotate"})
FILTERS = frozenset({"filter", "exclude", "get", "get_or_create", "update_or_create"})


class PathError(ValueError):
    """A path that cannot be resolved: reason is empty, segment_not_found, non_relation_intermediate,
    invalid_lookup_operator or relation_required."""

    def __init__(self, reason: str, path: str, segment: str = ""):
        super().__init__(f"{path}: {reason}" + (f" at {segment}" if segment else ""))
        self.reason, self.path, self.segment = reason, path, segment


@dataclass
class Resolved:
    fields: list[Field] = field(default_factory=list)
    owners: list[str] = field(default_factory=list)  # the model of each field
    transforms: list[str] = field(default_factory=list)
    lookup: str = ""
    kind: str = ""  # of the value after the transforms
    json_keys: list[str] = field(default_factory=list)

    @property
    def target(self) -> Field:
        return self.fields[-1]


def split(path: str, method: str = "") -> list[str]:
    """Segments of a path; a leading minus of order_by and empty segments go."""
    path = path.strip()
    if method == "order_by":
        path = path.removeprefix("-")
    return [s for s in path.split("__") if s]


def operators(kind: str, segments: list[str], path: str) -> tuple[list[str], str, str, list[str]]:
    """Transforms, lookup, final kind and JSON keys of the segments after a field; a transform goes before a lookup of its name."""
    applied: list[str] = []
    keys: list[str] = []
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s in transforms_of(kind):
            applied.append(s)
            kind = TRANSFORMS[s][0]
        elif s in lookups_of(kind) and last:
            return applied, s, kind, keys
        elif base_kind(kind) == "JSONField" and s not in lookups_of(kind):
            keys.append(s)
        elif keys and s in ("exact", "iexact", "contains", "icontains", "startswith", "endswith", "gt", "gte", "lt", "lte", "in", "regex", "iregex") and last:
            return applied, s, kind, keys
        else:
            raise PathError("invalid_lookup_operator", path, s)
    return applied, "", kind, keys


def resolve(catalog: Catalog, label: str, path: str, method: str = "filter", virtual: dict[str, str] | None = None) -> Resolved:
    """The fields a path goes through, and for filters the transforms and the lookup at its end.

    virtual has the kinds of annotations; such a name takes operators but no further fields.
    Query-name aliases are hidden from methods that name attributes.
    """
    segments = split(path, method)
    if not segments:
        raise PathError("empty", path)
    if virtual and segments[0] in virtual:
        kind = virtual[segments[0]]
        out = Resolved([Field(segments[0], kind, source="annotation")], [label])
        out.transforms, out.lookup, out.kind, out.json_keys = operators(kind, segments[1:], path)
        return out
    out, model = Resolved(), label
    for i, s in enumerate(segments):
        found = catalog.find(model, s) if model else None
        if found and found.source == "related_query_alias" and method in ATTRIBUTE_PATH:
            found = None
        if found is None:
            if not out.fields:
                raise PathError("segment_not_found", path, s)
            last = out.target
            lost = PathError("segment_not_found", path, s) if last.is_relation else PathError("non_relation_intermediate", path, segments[i - 1])
            if method not in FILTERS and method not in TRANSFORMING:
                raise lost
            kind = catalog.key_kind(last.target) if last.is_relation and not last.many and s not in lookups_of(last.kind) else last.kind
            try:
                out.transforms, out.lookup, out.kind, out.json_keys = operators(kind, segments[i:], path)
            except PathError:
                if method in TRANSFORMING:
                    raise lost from None
                raise
            if out.lookup and method in TRANSFORMING:
                raise lost
            return out
        out.fields.append(found)
        out.owners.append(model)
        model = found.target if found.is_relation else ""
    if method in RELATION_ONLY and not out.target.is_relation:
        raise PathError("relation_required", path, segments[-1])
    out.kind = out.target.kind
    return out


def resolve_all(catalog: Catalog, items: list[tuple[str, str, str]]) -> list[dict[str, str]]:
    """Results of (model, path, method) items in order; a bad item has its reason and stops no other."""
    out = []
    for label, path, method in items:
        try:
            r = resolve(catalog, label, path, method)
            out.append({"model": label, "path": path, "method": method, "resolved": "true", "reason": "", "target": r.target.name, "kind": r.target.kind, "lookup": r.lookup, "missing": ""})
        except (PathError, KeyError) as e:
            reason = e.reason if isinstance(e, PathError) else "unknown_model"
            out.append({"model": label, "path": path, "method": method, "resolved": "false", "reason": reason, "target": "", "kind": "", "lookup": "", "missing": getattr(e, "segment", "")})
    return out


def direct(catalog: Catalog, label: str, name: str) -> Field:
    """A field named without traversal or operator, as create, update and constraints need it."""
    if "__" in name:
        raise PathError("segment_not_found", name, name)
    found = catalog.find(label, name)
    if found is None or found.reverse_of:
        raise PathError("segment_not_found", name, name)
    return found
