"""Tables whose writes are commits: versions that name Parquet files, of which a write replaces only those it must.

A version is a manifest: the table's files with their numbers of rows. A write puts new files beside the old ones, and
counts once its manifest is there, which is made under a name that only one writer can take. Readers have the files of one version,
whatever is written meanwhile; what a writer leaves that dies before its commit is named by no manifest. Files that hold no row to change
are carried over by name, neither read whole nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FILE, _HIT = "+file", "+hit"


class Conflict(RuntimeError):
    """Another writer made the version that this one was to make."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    files: tuple[str, ...]  # below the table's folder
    done: dict[str, int]  # the last batch of each stream that is in it


class VersionedTable:
    """The table under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- files ------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """A version's manifest: the newest, or that of number; None of a table without any."""
        there = self.versions()
        if number is None and not there:
            return None
        number = there[-1] if number is None else number
        if number not in there:
            raise KeyError(f"version {number} of {self.folder} is not there")
        stream = self._fs.open(self._path(f"versions/{number}.json"))
        try:
            about = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, StructType.fromJson(about["schema"]), tuple(about["files"]), about["done"])

    def _commit(self, after: int, schema: StructType, files: tuple[str, ...], done: dict[str, int]) -> int:
        """Writes the manifest aside and gives it the name of the version after `after`, unless that is taken. Who dies before leaves no version."""
        to, aside = self._path(f"versions/{after + 1}.json"), self._path(f"versions/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "files": files, "done": done}).encode()))
        finally:
            out.close()
        jvm = self._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # a rename that never overwrites: of two writers one makes the version
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, to, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(aside, False)
            raise Conflict(f"version {after + 1} of {self.folder}") from None
        return after + 1

    def _written(self, df: DataFrame) -> tuple[str, ...]:
        """df in new files, which no version names yet. Spark's committer makes a task's files appear once, whatever is tried again."""
        at = f"data/{uuid.uuid4().hex}"
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder}/{at}")
        if not rows.get["n"]:
            return ()
        return tuple(f"{at}/{n}" for n in sorted(self._names(at)) if n.endswith(".parquet"))

    # ---- reads ------------------------------------------------------------------------------------

    def _read(self, schema: StructType, files: tuple[str, ...]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{f}" for f in files))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of version number."""
        v = self.version(number)
        if v is None:
            raise KeyError(f"{self.folder} has no version")
        return self._read(v.schema, v.files)

    def changes(self, old: int, new: int | None = None) -> DataFrame:
        """Rows that a version does not share with an older one, with `sign` 1 where they came and -1 where they went. Only files that the two do not
        share are read."""
        a, b = self.version(old), self.version(new)
        went, came = (self._read(x.schema, tuple(f for f in x.files if f not in set(y.files))) for x, y in ((a, b), (b, a)))
        return came.exceptAll(went).withColumn("sign", F.lit(1)).unionByName(went.exceptAll(came).withColumn("sign", F.lit(-1)))

    def _with_file(self, v: Version) -> DataFrame:
        df = self._read(v.schema, v.files)
        return df.withColumn(_FILE, F.col("_metadata.file_path") if v.files else F.lit(""))

    def _holding(self, v: Version, found: DataFrame) -> tuple[str, ...]:
        """Files of v that found names in its column _FILE. One name for each file comes to the driver, as in any read."""
        named = {r[0].rsplit("/data/", 1)[1] for r in found.select(_FILE).distinct().collect()}
        return tuple(f for f in v.files if f.removeprefix("data/") in named)

    # ---- writes: each gives the number of the new version ---------------------------------------------

    def create(self, df: DataFrame) -> int:
        """The first version."""
        return self._commit(-1, df.schema, self._written(df), {})

    def append(self, df: DataFrame, stream: str = "", batch: int = -1) -> int:
        """Adds rows. As batch number `batch` of a stream, only if no version has this or a later batch of it."""
        v = self.version()
        if v is None:
            schema, files, done, after = df.schema, (), {}, -1
        else:
            schema, files, done, after = v.schema, v.files, v.done, v.number
        if stream and done.get(stream, -1) >= batch:
            return after
        new = self._written(df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)))
        return self._commit(after, schema, (*files, *new), done | ({stream: batch} if stream else {}))

    def _replaced(self, v: Version, hit: tuple[str, ...], change: Callable[[DataFrame], DataFrame], more: DataFrame | None = None, done: dict[str, int] | None = None) -> int:
        """v with the rows of its files `hit` as change makes them, and with more rows."""
        new = change(self._read(v.schema, hit)).select(*v.schema.names) if hit else None
        if more is not None:
            more = more.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in v.schema))
            new = more if new is None else new.unionByName(more)
        files = self._written(new) if new is not None else ()
        if new is None and not done:
            return v.number
        kept = tuple(f for f in v.files if f not in set(hit))
        return self._commit(v.number, v.schema, (*kept, *files), v.done | (done or {}))

    def _marked(self, where: Column | DataFrame, names: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
        """A function that adds other names of columns, and _HIT to rows: whether a condition over them is true, or, for a DataFrame, whether
        its columns (named or own ones) have a row of these values."""

        def mark(df: DataFrame) -> DataFrame:
            df = df.withColumns({n: F.col(f"`{c}`") for n, c in names.items() if n not in df.columns})
            if isinstance(where, Column):
                return df.withColumn(_HIT, F.coalesce(where, F.lit(False)))
            keys = where.distinct().withColumn(_HIT, F.lit(True))
            return df.join(keys, where.columns, "left").withColumn(_HIT, F.coalesce(_HIT, F.lit(False)))

        return mark

    def _hit(self, v: Version, where: Column | DataFrame, names: dict[str, str]) -> tuple[str, ...]:
        df = self._with_file(v).withColumns({n: F.col(f"`{c}`") for n, c in names.items() if n not in v.schema.names})
        return self._holding(v, df.where(where) if isinstance(where, Column) else df.join(where.distinct(), where.columns, "left_semi"))

    def update(self, where: Column | DataFrame, values: dict[str, Column], names: dict[str, str] | None = None) -> int:
        """Values in the rows that where holds for: a condition, which reaches the Parquet scan that finds the files, or a table of keys.
        names are other names of columns, which conditions, keys and values may use."""
        v, names = self._now(), names or {}
        mark = self._marked(where, names)
        new = lambda f: F.when(F.col(_HIT), values[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
        return self._replaced(v, self._hit(v, where, names), lambda df: mark(df).select(*(new(f) if f.name in values else F.col(f"`{f.name}`") for f in v.schema)))

    def delete(self, where: Column | DataFrame, names: dict[str, str] | None = None) -> int:
        """Removes the rows that where holds for."""
        v, names = self._now(), names or {}
        mark = self._marked(where, names)
        return self._replaced(v, self._hit(v, where, names), lambda df: mark(df).where(~F.col(_HIT)))

    def merge(self, rows: DataFrame, keys: list[str], insert: bool = True, remove: str | None = None, update: list[str] | None = None, names: dict[str, str] | None = None, done: dict[str, int] | None = None) -> int:
        """Rows by key: those that are there take the columns of rows (or those named in update), others are added whole if insert is true.
        Where the column `remove` of rows is true, the row goes. Keys are compared null-safely; several rows of one key are an error.
        names are columns by the names that rows may have them under. done marks batches of streams as being in the version."""
        v = self._now()
        rows = rows.withColumnsRenamed({n: c for n, c in (names or {}).items() if n in rows.columns})
        if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError("several new rows have one key")
        given = [c for c in v.schema.names if c in rows.columns and c not in keys]
        columns = [c for c in given if update is None or c in update]
        new = rows.select(*(F.col(f"`{k}`").alias(f"+k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"+{c}") for c in given), (F.col(remove) if remove else F.lit(False)).alias("+gone"), F.lit(True).alias(_HIT))

        def on() -> Column:
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`+k{i}`"))
            return same

        def change(df: DataFrame) -> DataFrame:
            met = df.join(new, on(), "left").where(~F.coalesce(F.col("+gone"), F.lit(False)))
            return met.select(*(F.when(F.col(_HIT), F.col(f"`+{f.name}`").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in columns else F.col(f"`{f.name}`") for f in v.schema))

        hit = self._holding(v, self._with_file(v).join(new, on(), "left_semi"))
        more = None
        if insert:
            rest = new.where(~F.col("+gone")).join(self._read(v.schema, hit).select(*keys), on(), "left_anti")
            more = rest.select(*(F.col(f"`+k{keys.index(f.name)}`").alias(f.name) if f.name in keys else F.col(f"`+{f.name}`").alias(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in v.schema))
        return self._replaced(v, hit, change, more, done)

    def _now(self) -> Version:
        v = self.version()
        if v is None:
            raise KeyError(f"{self.folder} has no version")
        return v

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the newest `keep` versions, and files that none of those names. No write may be under way. Gives what went."""
        there = self.versions()
        old, kept = there[:-keep], there[-keep:]
        named = {f.split("/")[1] + "/" + f.split("/")[2] for n in kept for f in self.version(n).files}
        for n in old:
            self._fs.delete(self._path(f"versions/{n}.json"), False)
        gone = []
        for name in self._names("versions"):
            if name.startswith("_"):
                self._fs.delete(self._path(f"versions/{name}"), False)
        for folder in self._names("data"):
            for name in self._names(f"data/{folder}"):
                if name.endswith(".parquet") and f"{folder}/{name}" not in named:
                    self._fs.delete(self._path(f"data/{folder}/{name}"), False)
                    gone.append(f"data/{folder}/{name}")
        return gone
