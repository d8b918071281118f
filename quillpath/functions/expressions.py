"""Expressions of the query algebra. Each builds a Column from a query's columns; none reads data."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window as SparkWindow
from pyspark.sql import functions as F


class Expr:
    """build(q) gives the Column; q.column(path) finds a path's column, joining as needed. kind is a field kind."""

    kind = "annotation"

    def build(self, q: Any) -> Column:
        raise NotImplementedError

    def _with(self, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        return _Combined(self, other, f)

    def __add__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a / b)

    def __radd__(self, o: Any) -> Expr:
        return Value(o) + self

    def __rsub__(self, o: Any) -> Expr:
        return Value(o) - self

    def __rmul__(self, o: Any) -> Expr:
        return Value(o) * self

    def asc(self) -> Order:
        return Order(self, False)

    def desc(self) -> Order:
        return Order(self, True)


def built(x: Any, q: Any, paths: bool = True) -> Column:
    """The Column of an argument: a string is a path where paths are taken, else a literal."""
    if isinstance(x, Expr):
        return x.build(q)
    return q.column(x) if paths and isinstance(x, str) else F.lit(x)


class _Combined(Expr):
    def __init__(self, a: Any, b: Any, f: Callable[[Column, Column], Column]):
        self.a, self.b, self.f = a, b, f

    def build(self, q: Any) -> Column:
        return self.f(built(self.a, q, False), built(self.b, q, False))


class Order:
    def __init__(self, expr: Any, descending: bool):
        self.expr, self.descending = expr, descending

    def build(self, q: Any) -> Column:
        c = built(self.expr, q)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


class F_(Expr):
    """A path as a value."""

    def __init__(self, path: str):
        self.path = path

    def build(self, q: Any) -> Column:
        return q.column(self.path)


class OuterRef(Expr):
    """A path of the query around a subquery."""

    def __init__(self, path: str):
        self.path = path

    def build(self, q: Any) -> Column:
        raise ValueError("OuterRef belongs in the filter of a subquery")


class Value(Expr):
    def __init__(self, value: Any):
        self.value = value

    def build(self, q: Any) -> Column:
        return F.lit(self.value)


class Q:
    """Lookups joined by and, or, not."""

    def __init__(self, *parts: Q, **lookups: Any):
        self.op, self.parts, self.lookups, self.negated = "and", parts, lookups, False

    def _join(self, other: Q, op: str) -> Q:
        out = Q(self, other)
        out.op = op
        return out

    def __and__(self, o: Q) -> Q:
        return self._join(o, "and")

    def __or__(self, o: Q) -> Q:
        return self._join(o, "or")

    def __invert__(self) -> Q:
        out = Q(self)
        out.negated = True
        return out

    def build(self, q: Any) -> Column:
        conditions = [p.build(q) for p in self.parts] + [q.condition(k, v) for k, v in self.lookups.items()]
        total = F.lit(self.op == "and")
        for i, c in enumerate(conditions):
            total = c if i == 0 else (total & c if self.op == "and" else total | c)
        return ~F.coalesce(total, F.lit(False)) if self.negated else total

    def paths(self) -> list[str]:
        return [*self.lookups, *(x for p in self.parts if isinstance(p, Q) for x in p.paths())]

    def without(self, prefix: str) -> Q:
        """The same under a model that prefix leads to."""
        out = Q(*(p.without(prefix) for p in self.parts), **{k.removeprefix(f"{prefix}__") if k.startswith(f"{prefix}__") else k: v for k, v in self.lookups.items()})
        out.op, out.negated = self.op, self.negated
        return out


class When:
    def __init__(self, condition: Q | None = None, then: Any = None, **lookups: Any):
        self.condition = Q(*([condition] if condition else []), **lookups)
        self.then = then


class Case(Expr):
    def __init__(self, *whens: When, default: Any = None):
        self.whens, self.default = whens, default

    def build(self, q: Any) -> Column:
        out = F
        for w in self.whens:
            out = out.when(w.condition.build(q), built(w.then, q, False))
        return out if self.default is None else out.otherwise(built(self.default, q, False))


class Cast(Expr):
    def __init__(self, expr: Any, to: str):
        self.expr, self.to = expr, to

    def build(self, q: Any) -> Column:
        return built(self.expr, q).cast(self.to)


class ExpressionWrapper(Cast):
    """expr as the Spark type of output_field."""

    def __init__(self, expr: Any, output_field: str):
        super().__init__(expr, output_field)


class Func(Expr):
    """A Spark function by name over paths and expressions."""

    def __init__(self, *args: Any, function: str):
        self.args, self.function = args, function

    def build(self, q: Any) -> Column:
        return F.call_function(self.function, *(built(a, q) for a in self.args))


class _Simple(Expr):
    """A function of one path or expression and literals."""

    make: Callable[..., Column]

    def __init__(self, expr: Any, *rest: Any):
        self.expr, self.rest = expr, rest

    def build(self, q: Any) -> Column:
        return type(self).make(built(self.expr, q), *(r.build(q) if isinstance(r, Expr) else r for r in self.rest))


def _simple(name: str, make: Callable[..., Column], kind: str = "annotation") -> type[_Simple]:
    return type(name, (_Simple,), {"make": staticmethod(make), "kind": kind, "__doc__": f"{name} of a path or expression."})


class _Many(Expr):
    make: Callable[..., Column]

    def __init__(self, *args: Any):
        self.args = args

    def build(self, q: Any) -> Column:
        return type(self).make(*(built(a, q) for a in self.args))


def _many(name: str, make: Callable[..., Column]) -> type[_Many]:
    return type(name, (_Many,), {"make": staticmethod(make), "__doc__": f"{name} of several paths or expressions."})


Coalesce = _many("Coalesce", F.coalesce)
Greatest = _many("Greatest", F.greatest)
Least = _many("Least", F.least)
#: Nulls count as empty texts.
Concat = _many("Concat", lambda *c: F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in c)))
Length = _simple("Length", F.length, "IntegerField")
Replace = _simple("Replace", lambda c, old, new="": F.replace(c, F.lit(old), F.lit(new)), "CharField")
Substr = _simple("Substr", lambda c, pos, n=None: F.substr(c, F.lit(pos), *([F.lit(n)] if n is not None else [])), "CharField")
Collate = _simple("Collate", lambda c, name: F.collate(c, {"C": "UTF8_BINARY", "NOCASE": "UTF8_LCASE"}.get(name, name)), "CharField")
Extract = _simple("Extract", lambda c, part: F.extract(F.lit(part), c), "IntegerField")
ExtractYear = _simple("ExtractYear", F.year, "IntegerField")
ExtractMonth = _simple("ExtractMonth", F.month, "IntegerField")
ExtractDay = _simple("ExtractDay", F.dayofmonth, "IntegerField")
ExtractWeek = _simple("ExtractWeek", F.weekofyear, "IntegerField")
ExtractWeekDay = _simple("ExtractWeekDay", F.dayofweek, "IntegerField")
ExtractQuarter = _simple("ExtractQuarter", F.quarter, "IntegerField")
ExtractHour = _simple("ExtractHour", F.hour, "IntegerField")
ExtractMinute = _simple("ExtractMinute", F.minute, "IntegerField")
ExtractSecond = _simple("ExtractSecond", F.second, "IntegerField")
TruncDate = _simple("TruncDate", F.to_date, "DateField")


class JSONObject(Expr):
    """A JSON object of paths by key."""

    kind = "JSONField"

    def __init__(self, **members: Any):
        self.members = members

    def build(self, q: Any) -> Column:
        return F.to_json(F.struct(*(built(v, q).alias(k) for k, v in self.members.items())))


# ---- aggregates --------------------------------------------------------------------------------------


class Aggregate(Expr):
    """An aggregate of a path (or "*"), perhaps of distinct values and under a condition."""

    empty: Any = None  # for rows without related ones

    def __init__(self, path: Any, distinct: bool = False, filter: Q | None = None):  # noqa: A002
        self.path, self.distinct, self.filter = path, distinct, filter

    def value(self, q: Any) -> Column:
        c = F.lit(1) if self.path == "*" else built(self.path, q)
        return c if self.filter is None else F.when(self.filter.build(q), c)

    def build(self, q: Any) -> Column:
        return self.make(self.value(q))

    def make(self, c: Column) -> Column:
        raise NotImplementedError

    def below(self, prefix: str) -> Aggregate:
        """The same aggregate over the model that prefix leads to."""
        import copy

        out = copy.copy(self)
        path = self.path.path if isinstance(self.path, F_) else self.path
        out.path = "*" if path == prefix else path.removeprefix(f"{prefix}__")
        out.filter = self.filter.without(prefix) if self.filter else None
        return out


class Count(Aggregate):
    kind, empty = "IntegerField", 0

    def make(self, c: Column) -> Column:
        return F.count_distinct(c) if self.distinct else F.count(c)


class Sum(Aggregate):
    def make(self, c: Column) -> Column:
        return F.sum_distinct(c) if self.distinct else F.sum(c)


class Avg(Aggregate):
    def make(self, c: Column) -> Column:
        return F.avg(c)


class Min(Aggregate):
    def make(self, c: Column) -> Column:
        return F.min(c)


class Max(Aggregate):
    def make(self, c: Column) -> Column:
        return F.max(c)


class ArrayAgg(Aggregate):
    """Values in ascending order."""

    def make(self, c: Column) -> Column:
        return F.array_sort(F.collect_set(c) if self.distinct else F.collect_list(c))


class JSONBAgg(ArrayAgg):
    kind = "JSONField"

    def make(self, c: Column) -> Column:
        return F.to_json(super().make(c))


class StringAgg(Aggregate):
    """Values in ascending order with a delimiter between them."""

    def __init__(self, path: Any, delimiter: str = ",", distinct: bool = False, filter: Q | None = None):  # noqa: A002
        super().__init__(path, distinct, filter)
        self.delimiter = delimiter

    def make(self, c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c) if self.distinct else F.collect_list(c)), self.delimiter)


# ---- windows -----------------------------------------------------------------------------------------


class _WindowFunction(Expr):
    def __init__(self, path: Any, offset: int = 1, default: Any = None):
        self.path, self.offset, self.default = path, offset, default


class Lag(_WindowFunction):
    def build(self, q: Any) -> Column:
        return F.lag(built(self.path, q), self.offset, self.default)


class Lead(_WindowFunction):
    def build(self, q: Any) -> Column:
        return F.lead(built(self.path, q), self.offset, self.default)


class FirstValue(_WindowFunction):
    def build(self, q: Any) -> Column:
        return F.first_value(built(self.path, q))


class LastValue(_WindowFunction):
    def build(self, q: Any) -> Column:
        return F.last_value(built(self.path, q))


class NthValue(_WindowFunction):
    def build(self, q: Any) -> Column:
        return F.nth_value(built(self.path, q), self.offset)


class Window(Expr):
    """An aggregate or window function over partitions; with an order, up to the current row."""

    def __init__(self, expression: Expr, partition_by: Any = (), order_by: Any = ()):
        self.expression = expression
        self.partition_by = partition_by if isinstance(partition_by, (list, tuple)) else [partition_by]
        self.order_by = order_by if isinstance(order_by, (list, tuple)) else [order_by]

    def build(self, q: Any) -> Column:
        w = SparkWindow.partitionBy(*(built(p, q) for p in self.partition_by))
        if self.order_by:
            w = w.orderBy(*(q.order(o) for o in self.order_by))
        return self.expression.build(q).over(w)


# ---- subqueries --------------------------------------------------------------------------------------


class Subquery(Expr):
    """The first value of a query for each outer row."""

    def __init__(self, query: Any):
        self.query = query

    def build(self, q: Any) -> Column:
        return q.subquery(self.query, "first")


class ArraySubquery(Subquery):
    """All values in ascending order, empty without any."""

    def build(self, q: Any) -> Column:
        return q.subquery(self.query, "array")


class Exists(Subquery):
    kind = "BooleanField"
    negated = False

    def __invert__(self) -> Exists:
        out = Exists(self.query)
        out.negated = not self.negated
        return out

    def build(self, q: Any) -> Column:
        found = q.subquery(self.query, "exists")
        return ~found if self.negated else found
