"""Counts and sums kept current from changes alone.

A change is a row with a sign: 1 where it came, -1 where it went, an update being both. Signs multiply through joins and add up in
groups, so what changes in a view is worked out from the changed rows, and merged into the view's table by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpath.sources.versioned import VersionedTable

SIGN = "sign"


def signed(came: DataFrame, went: DataFrame | None = None) -> DataFrame:
    out = came.withColumn(SIGN, F.lit(1))
    return out if went is None else out.unionByName(went.withColumn(SIGN, F.lit(-1)))


def joined(a: DataFrame, a_changes: DataFrame, b: DataFrame, b_changes: DataFrame, on: list[str]) -> DataFrame:
    """Changes of the inner join of a and b on the columns `on`, from the rows before and the signed changes of both: each side's changes
    meet the other side, and one of them the other's changes too."""
    other = b_changes.withColumnRenamed(SIGN, "+s")
    first = a_changes.join(b, on)
    after = signed(a).unionByName(a_changes)
    return first.unionByName(after.join(other, on).withColumn(SIGN, F.col(SIGN) * F.col("+s")).drop("+s"))


class SumView:
    """n (rows) and sums by key, as a versioned table. Sums are exact: values are taken as decimals with `scale` digits after the point."""

    def __init__(self, table: VersionedTable, keys: list[str], sums: dict[str, str], scale: int = 4):
        self.table, self.keys, self.sums, self.scale = table, keys, sums, scale

    def _grouped(self, changes: DataFrame) -> DataFrame:
        value = lambda c: F.coalesce(F.col(c).cast(f"decimal(24,{self.scale})"), F.lit(0)) * F.col(SIGN)
        return changes.groupBy(*self.keys).agg(F.sum(F.col(SIGN).cast("long")).alias("n"), *(F.sum(value(c)).cast(f"decimal(38,{self.scale})").alias(name) for name, c in self.sums.items()))

    def build(self, rows: DataFrame) -> int:
        """The first version, in files of key ranges, so that changes of few keys touch few files where keys come in runs."""
        return self.table.create(self._grouped(signed(rows)).repartitionByRange(*self.keys))

    def apply(self, changes: DataFrame, stream: str = "changes", batch: int | None = None) -> int:
        """Merges signed changes; a batch that a version has, or a later one, is passed over. Only keys of changes are grouped and met with
        the view, whose rows of other keys are not moved but for those that share a file with one. Keys without rows go."""
        v = self.table.version()
        if batch is not None and v.done.get(stream, -1) >= batch:
            return v.number
        delta = self._grouped(changes)
        names = ["n", *self.sums]
        old = self.table.read().select(*(F.col(k).alias(f"+{k}") for k in self.keys), *(F.col(c).alias(f"+{c}") for c in names))
        same: Column = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"+{k}"))
        now = delta.join(old, same, "left").select(*self.keys, *((F.col(c) + F.coalesce(F.col(f"+{c}"), F.lit(0))).cast(delta.schema[c].dataType).alias(c) for c in names))
        rows = now.withColumn("+none", F.col("n") == 0)
        return self.table.merge(rows, self.keys, remove="+none", done=None if batch is None else {stream: batch})

    def read(self) -> DataFrame:
        return self.table.read()
