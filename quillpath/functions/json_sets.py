"""Containment of JSON values at any depth.

An object is contained in another that has all its members, each containing the member's value; an array in one
that has, for each of its elements, an element that contains it, in any order and number; scalars in equal ones, numbers by
value. At the top an array also contains its elements themselves. With a literal on one side this is a predicate over VARIANT
values; between two columns it is a relation: rows whose values do not go on below some depth are answered by a predicate, and
the others from the top down and then from the leaves up.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, localcontext
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpath.plans.metadata import stored

_EXACT = "decimal(38,9)"

#: Containers in each other down to which rows are answered by an expression, which grows with the power of two of it.
DEPTH = 3


def parsed(c: Column) -> Column:
    """JSON text as VARIANT; null where it is none."""
    return F.try_parse_json(c)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _member(v: Column, name: str) -> Column:
    """A member of an object; null where there is none."""
    if "'" not in name and "\\" not in name:
        return F.try_variant_get(v, f"$['{name}']", "variant")
    return F.try_element_at(_object(v), F.lit(name))


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _numeric(v: Column) -> Column:
    return _type(v).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _is(v: Column, value: Any) -> Column:
    """Whether v is the scalar value."""
    if value is None:
        return _true(F.is_variant_null(v))
    if isinstance(value, bool):
        return _true((_type(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value)))
    if isinstance(value, (int, float, Decimal)):
        with localcontext() as context:
            context.prec = 60
            exact = Decimal(str(value))
        fits = abs(exact) < 10**29 and exact == round(exact, 9)
        same = F.try_variant_get(v, "$", _EXACT) == F.lit(format(exact, "f")).cast(_EXACT) if fits else F.try_variant_get(v, "$", "double") == F.lit(float(value))
        return _true(_numeric(v) & same)
    return _true((_type(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(value))))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def contains(v: Column, value: Any, top: bool = True) -> Column:
    """Whether the VARIANT v contains a literal of dicts, lists and scalars."""
    if isinstance(value, dict):
        return _true(_object(v).isNotNull()) & _all([contains(_member(v, str(k)), x, False) for k, x in value.items()])
    if isinstance(value, (list, tuple)):
        elements = _array(v)
        return elements.isNotNull() & _all([_some(elements, x) for x in value])
    return (_is(v, value) | _some(_array(v), value)) if top else _is(v, value)


def _some(elements: Column, value: Any) -> Column:
    """Whether an element of an array of VARIANT contains value."""
    return _true(F.exists(elements, lambda e: contains(e, value, False)))


def contained_by(v: Column, value: Any, top: bool = True) -> Column:
    """Whether the VARIANT v is contained in a literal."""
    if isinstance(value, dict):
        members = _object(v)
        known = F.size(F.array_except(F.map_keys(members), F.array(*(F.lit(str(k)) for k in value)).cast("array<string>"))) == 0
        return _true(members.isNotNull() & known) & _all([_member(v, str(k)).isNull() | contained_by(_member(v, str(k)), x, False) for k, x in value.items()])
    if isinstance(value, (list, tuple)):
        held = _true(F.forall(_array(v), lambda e: _any([contained_by(e, x, False) for x in value])))
        return held | _any([_is(v, x) for x in value if not isinstance(x, (dict, list, tuple))]) if top else held
    return _is(v, value)


def _same(a: Column, b: Column) -> Column:
    """Whether two scalars are equal."""
    get = F.try_variant_get
    numbers = _numeric(a) & _numeric(b) & F.coalesce(get(a, "$", _EXACT) == get(b, "$", _EXACT), get(a, "$", "double") == get(b, "$", "double"))
    texts = (_type(a) == _type(b)) & _type(a).isin("STRING", "BOOLEAN") & (get(a, "$", "string") == get(b, "$", "string"))
    return _true(F.is_variant_null(a) & F.is_variant_null(b)) | _true(numbers) | _true(texts)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once for a row, however often f's lambdas use it."""
    return F.transform(F.array(value), f)[0]


def _listed(b: Column, s: Column, top: bool) -> Column:
    """The elements that b must have if s is to be in it as an array."""
    return F.coalesce(_array(s), F.when(_object(s).isNull() & _array(b).isNotNull(), F.array(s))) if top else _array(s)


def _decided(b: Column, s: Column, top: bool) -> Column:
    """Whether b contains s where that takes no look into members or elements, else null."""
    listed = _listed(b, s, top)
    return (
        F.when(b.isNull() | s.isNull(), False)
        .when(_object(s).isNotNull(), F.when(_object(b).isNull(), False).when(F.size(_object(s)) == 0, True))
        .when(listed.isNotNull(), F.when(_array(b).isNull(), False).when(F.size(listed) == 0, True))
        .otherwise(_same(b, s))
    )


def _holds(b: Column, s: Column, depth: int, top: bool = True) -> Column:
    """Whether the VARIANT b contains the VARIANT s; null where it takes a look at more than depth containers in each other."""
    if not depth:
        return _decided(b, s, top)
    members = _with(_object(b), lambda m: F.forall(F.map_entries(_object(s)), lambda e: _holds(F.try_element_at(m, e["key"]), e["value"], depth - 1, False)))
    elements = _with(_array(b), lambda m: F.forall(_listed(b, s, top), lambda x: F.exists(m, lambda y: _holds(y, x, depth - 1, False))))
    return (
        F.when(b.isNull() | s.isNull(), False)
        .when(_object(s).isNotNull(), F.when(_object(b).isNull(), False).otherwise(members))
        .when(_listed(b, s, top).isNotNull(), F.when(_array(b).isNull(), False).otherwise(elements))
        .otherwise(_same(b, s))
    )


def contained(df: DataFrame, key: str, big: str, small: str) -> DataFrame:
    """key and contained: whether the JSON text big contains the JSON text small, for rows of different, non-null keys. Text that is no JSON
    or null contains nothing and is contained in nothing.

    One pass answers the rows that DEPTH containers in each other answer, and writes the others' texts, which go on level by level.
    """
    texts = df.select(F.col(key).alias("key"), F.col(big).alias("big"), F.col(small).alias("small"))
    pairs = texts.withColumns({"b": parsed(F.col("big")), "s": parsed(F.col("small"))}).withColumn("holds", _holds(F.col("b"), F.col("s"), DEPTH))
    once = stored(pairs.select("key", "holds", *(F.when(F.col("holds").isNull(), F.col(c)).alias(c) for c in ("big", "small"))))
    result, deep = once.where("holds is not null").select("key", "holds"), once.where("holds is null")
    if not deep.isEmpty():
        result = result.unionByName(_by_levels(deep))
    return result.select(F.col("key").alias(key), F.col("holds").alias("contained"))


def _by_levels(df: DataFrame) -> DataFrame:
    """key and holds of the rows (key, big, small).

    Every level of nesting is a table of pairs still to be compared: a member with the other side's member, an
    element with each element of the other side. A pair holds if each of its slots (members, elements of small) has a pair that
    holds. Levels are joined with their parents' results from the deepest up; nothing depends on how deep values are.
    """
    now = df.select("key", F.lit("").alias("node"), F.lit("").alias("parent"), F.lit(0).alias("slot"), parsed(F.col("big")).alias("b"), parsed(F.col("small")).alias("s"))
    levels: list[DataFrame] = []
    top = True
    while True:
        b, s = F.col("b"), F.col("s")
        levels.append(stored(now.withColumn("done", _decided(b, s, top))))
        open_ = levels[-1].where("done is null")
        if open_.isEmpty():
            break
        both = open_.withColumn("listed", _listed(b, s, top))
        members = both.where(_object(s).isNotNull()).select("key", F.col("node").alias("parent"), _object(b).alias("bs"), F.posexplode(F.map_entries(_object(s))).alias("slot", "e"))
        members = members.select("key", "parent", "slot", F.lit(0).alias("place"), F.try_element_at("bs", F.col("e.key")).alias("b"), F.col("e.value").alias("s"))
        elements = both.where("listed is not null").select("key", F.col("node").alias("parent"), _array(b).alias("bs"), F.posexplode("listed").alias("slot", "s"))
        elements = elements.select("key", "parent", "slot", "s", F.posexplode_outer("bs").alias("place", "b")).withColumn("place", F.coalesce("place", F.lit(0)))
        now = members.unionByName(elements).withColumn("node", F.concat_ws("/", "parent", F.concat_ws(":", "slot", "place"))).select("key", "node", "parent", "slot", "b", "s")
        top = False
    result = levels[-1].select("key", "node", "parent", "slot", F.col("done").alias("holds"))
    for level in reversed(levels[:-1]):
        slots = result.groupBy("key", "parent", "slot").agg(F.max("holds").alias("holds"))
        above = slots.groupBy("key", F.col("parent").alias("node")).agg(F.min("holds").alias("_held"))
        result = level.join(above, ["key", "node"], "left").select("key", "node", "parent", "slot", F.coalesce("done", "_held").alias("holds"))
    return result.select("key", "holds")
