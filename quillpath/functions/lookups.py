"""Lookups and transforms by field kind, and the Column each of them builds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which lookups and transforms each field kind takes.
_COMPARED = ("exact", "gt", "gte", "lt", "lte", "in", "range")
_TEXT = ("exact", "iexact", "contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "in", "gt", "gte", "lt", "lte")
_DATE_PARTS = ("year", "month", "day", "week", "week_day", "iso_year", "iso_week_day", "quarter")
_CLOCK_PARTS = ("hour", "minute", "second")
_FILE = ("exact", "iexact", "contains", "icontains", "startswith", "endswith", "in", "isnull")
_KEY = ("exact", "in", "isnull", "gt", "gte", "lt", "lte")
LOOKUPS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("CharField", "TextField", "SlugField", "URLField", "EmailField", "FilePathField"), (*_TEXT, "range", "regex", "iregex", "isnull")),
    "UUIDField": ("exact", "in", "isnull"),
    "GenericIPAddressField": (*_TEXT, "isnull"),
    **dict.fromkeys(
        ("IntegerField", "BigIntegerField", "SmallIntegerField", "PositiveIntegerField", "PositiveSmallIntegerField", "PositiveBigIntegerField", "FloatField", "DecimalField", "AutoField", "BigAutoField", "SmallAutoField", "DurationField"),
        (*_COMPARED, "isnull"),
    ),
    "DateField": (*_COMPARED, *_DATE_PARTS, "isnull"),
    "DateTimeField": (*_COMPARED, *_DATE_PARTS, *_CLOCK_PARTS, "date", "time", "isnull"),
    "TimeField": (*_COMPARED, *_CLOCK_PARTS, "isnull"),
    "BooleanField": ("exact", "isnull"),
    "NullBooleanField": ("exact", "isnull"),
    "ForeignKey": _KEY,
    "OneToOneField": _KEY,
    "ManyToManyField": ("exact", "in", "isnull"),
    "JSONField": ("exact", "isnull", "contains", "contained_by", "has_key", "has_keys", "has_any_keys"),
    "BinaryField": ("exact", "isnull"),
    "FileField": _FILE,
    "ImageField": _FILE,
}
#: For kinds that the table does not know.
DEFAULT_LOOKUPS = ("exact", "in", "isnull", "gt", "gte", "lt", "lte")
_WORDY = ("CharField", "TextField", "SlugField", "URLField", "EmailField")
_DATED = ("DateField", "DateTimeField")
_TIMED = ("TimeField", "DateTimeField")
#: name: kind of the result, kinds it applies to.
TRANSFORMS: dict[str, tuple[str, tuple[str, ...]]] = {
    "lower": ("CharField", _WORDY), "upper": ("CharField", _WORDY), "length": ("IntegerField", _WORDY),
    "trim": ("CharField", _WORDY[:2]), "ltrim": ("CharField", _WORDY[:2]), "rtrim": ("CharField", _WORDY[:2]),
    "year": ("IntegerField", _DATED), "month": ("IntegerField", _DATED), "day": ("IntegerField", _DATED),
    "hour": ("IntegerField", _TIMED), "minute": ("IntegerField", _TIMED), "second": ("IntegerField", _TIMED),
    "date": ("DateField", ("DateTimeField",)), "time": ("TimeField", ("DateTimeField",)),
    "week": ("IntegerField", _DATED), "week_day": ("IntegerField", _DATED), "quarter": ("IntegerField", _DATED),
    "iso_year": ("IntegerField", _DATED), "iso_week_day": ("IntegerField", _DATED),
}

#: Kinds of projects' own field classes, by the kind they behave like.
KIND_ALIASES: dict[str, str] = {}


def register_kind(kind: str, base: str) -> None:
    KIND_ALIASES[kind] = base


def base_kind(kind: str) -> str:
    kind = kind.removeprefix("reverse_")
    while kind in KIND_ALIASES:
        kind = KIND_ALIASES[kind]
    return {"ParentalKey": "ForeignKey", "ParentalManyToManyField": "ManyToManyField"}.get(kind, kind)


#: (kind or "" for all kinds, name) of projects' own lookups.
CUSTOM: dict[tuple[str, str], Callable[[Column, Any], Column]] = {}


def register_lookup(name: str, build: Callable[[Column, Any], Column], kind: str = "") -> None:
    CUSTOM[kind, name] = build


def lookups_of(kind: str) -> tuple[str, ...]:
    own = tuple(n for k, n in CUSTOM if k in ("", kind, base_kind(kind)))
    return (*LOOKUPS.get(base_kind(kind), DEFAULT_LOOKUPS), *own)


def transforms_of(kind: str) -> tuple[str, ...]:
    return tuple(n for n, (_, kinds) in TRANSFORMS.items() if base_kind(kind) in kinds)


def transform(name: str, c: Column, kind: str) -> Column:
    clock = base_kind(kind) == "TimeField"  # HH:mm:ss.SSSSSS
    parts = {"hour": 1, "minute": 4, "second": 7}
    if clock and name in parts:
        return F.substring(c, parts[name], 2).cast("int")
    return {
        "lower": F.lower, "upper": F.upper, "length": F.length, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "date": F.to_date, "time": lambda x: F.date_format(x, "HH:mm:ss.SSSSSS"), "week": F.weekofyear, "week_day": F.dayofweek, "quarter": F.quarter,
        "iso_year": lambda x: F.extract(F.lit("YEAROFWEEK"), x), "iso_week_day": lambda x: F.weekday(x) + 1,
    }[name](c)


def _keys(c: Column, names: list[str]) -> list[Column]:
    return [F.coalesce(F.array_contains(F.json_object_keys(c), n), F.lit(False)) for n in names]


def _all(conditions: list[Column], empty: bool) -> Column:
    out = F.lit(empty)
    for c in conditions:
        out = (out & c) if empty else (out | c)
    return out


def predicate(name: str, c: Column, value: Any, kind: str) -> Column:
    """The condition that c stands in the relation `name` to value, a literal or a Column."""
    if custom := CUSTOM.get((kind, name)) or CUSTOM.get((base_kind(kind), name)) or CUSTOM.get(("", name)):
        return custom(c, value)
    lit = value if isinstance(value, Column) or isinstance(value, (list, tuple, set, frozenset, range)) or value is None else F.lit(value)
    if base_kind(kind) == "JSONField" and name in ("contains", "contained_by"):
        from quillpath.functions import json_sets

        if isinstance(value, Column):
            raise TypeError("JSON containment between columns is a relation: json_sets.contained")
        return F.coalesce((json_sets.contains if name == "contains" else json_sets.contained_by)(json_sets.parsed(c), value), F.lit(False))
    match name:
        case "exact":
            return c.isNull() if value is None else c == lit
        case "iexact":
            return c.isNull() if value is None else F.lower(c) == F.lower(lit)
        case "contains":
            return c.contains(lit)
        case "icontains":
            return F.lower(c).contains(F.lower(lit))
        case "startswith":
            return c.startswith(lit)
        case "istartswith":
            return F.lower(c).startswith(F.lower(lit))
        case "endswith":
            return c.endswith(lit)
        case "iendswith":
            return F.lower(c).endswith(F.lower(lit))
        case "gt":
            return c > lit
        case "gte":
            return c >= lit
        case "lt":
            return c < lit
        case "lte":
            return c <= lit
        case "in":
            items = [v for v in value if v is not None]
            return c.isin(items) if items else F.lit(False)
        case "range":
            low, high = value
            return c.between(low, high)
        case "isnull":
            return c.isNull() if value else c.isNotNull()
        case "regex":
            return F.rlike(c, lit)
        case "iregex":
            return F.rlike(c, F.concat(F.lit("(?i)"), lit))
        case "has_key":
            return _keys(c, [value])[0]
        case "has_keys":
            return _all(_keys(c, list(value)), True)
        case "has_any_keys":
            return _all(_keys(c, list(value)), False)
    if name in TRANSFORMS:
        return transform(name, c, kind) == lit
    raise ValueError(f"no lookup {name}")
