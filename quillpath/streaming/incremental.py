"""A model index kept current from a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillpath.plans import metadata
from quillpath.sources.modules import SCHEMA, read_modules
from quillpath.sources.source_files import changes as changes_of

CHANGE = "path string, text string, deleted boolean, version long"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    return changes.groupBy("path").agg(F.max_by(F.struct("text", "deleted"), "version").alias("c"), F.max("version").alias("version")).select("path", "c.text", "c.deleted", "version")


def _differences(modules: DataFrame, changes: DataFrame) -> DataFrame:
    """SCHEMA and gone: what changes do to modules. A text that is no Python leaves the module as it was, unless its path is new."""
    last = latest(changes)
    parsed = read_modules(last.where("not deleted"))
    good = parsed.where("error is null").unionByName(parsed.where("error is not null").join(modules.select("path"), "path", "left_anti"))
    gone = last.where("deleted").select("path").join(good.select("path"), "path", "left_anti")
    return good.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)


def applied(modules: DataFrame, changes: DataFrame) -> DataFrame:
    """modules after changes: deleted files go, parsed ones replace, and where a new text is no Python the old module stays."""
    new = _differences(modules, changes)
    return modules.join(new.select("path"), "path", "left_anti").unionByName(new.where("not gone").drop("gone"))


def model_part(modules: DataFrame) -> DataFrame:
    """path, fingerprint of what models, fields and names depend on; equal ones need no further work."""
    parts = F.to_json(F.struct("module", "imports", "classes", "fields", "aliases", "explicit_all", "symbols"))
    return modules.select("path", F.sha2(parts.cast("binary"), 256).alias("fingerprint"))


def affected(changed: DataFrame, bases: DataFrame, edges: DataFrame) -> DataFrame:
    """label of the changed models, all that inherit from one, and all that relate to one; bases and edges
    hold the old and the new rows, so that a removed relation reaches its old target too."""
    below = metadata.fixpoint(changed.select("label"), lambda new: bases.join(new, F.col("base") == F.col("label")).select(F.col("model").alias("label")), ["label"])
    near = edges.join(below, F.col("target") == F.col("label")).select(F.col("source").alias("label"))
    far = edges.join(below, F.col("source") == F.col("label")).select(F.col("target").alias("label"))
    return below.unionByName(near).unionByName(far).distinct()


def replaced(old: DataFrame, new: DataFrame, labels: DataFrame, key: str = "model") -> DataFrame:
    """old with the rows of labels from new."""
    names = labels.select(F.col("label").alias(key))
    return old.join(names, key, "left_anti").unionByName(new.join(names, key, "left_semi"))


def differing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """label: values of key whose rows are not the same in both tables, by one number for the rows of each."""
    whole = lambda df, name: df.groupBy(F.col(key).alias("label")).agg(F.count("*").alias(f"{name}_n"), *(F.sum(F.xxhash64(F.lit(k), F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias(f"{name}{k}") for k in (0, 1)))
    both = whole(old, "a").join(whole(new, "b"), "label", "full")
    same = F.lit(True)
    for k in ("_n", "0", "1"):
        same = same & F.col(f"a{k}").eqNullSafe(F.col(f"b{k}"))
    return both.where(~same).select("label")


#: Batches after which an index writes its whole table; between, only what changed.
WHOLE_EVERY = 16


class Index:
    """Versions of the module table under a folder: version=N has what batch N changed, whole=N the table after it.

    A version counts once Spark's committer has marked its folder complete. A new Index of the same
    folder goes on from the newest of them, and a batch that was already applied is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.whole, self.deltas = self._found("whole"), self._found("version")
        self.batch = max([*self.whole, *self.deltas], default=-1)

    def _found(self, kind: str) -> list[int]:
        """Complete versions of a kind, ascending."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        status = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in status)

    def modules(self) -> DataFrame:
        last = self.whole[-1] if self.whole else -1
        rows = self.spark.createDataFrame([], f"{SCHEMA}, gone boolean, version int")
        if self.whole:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/whole={last}").withColumn("gone", F.lit(False)).withColumn("version", F.lit(last))
        for n in (n for n in self.deltas if n > last):
            rows = rows.unionByName(self.spark.read.schema(f"{SCHEMA}, gone boolean").parquet(f"{self.folder}/version={n}").withColumn("version", F.lit(n)))
        newest = rows.groupBy("path").agg(F.max("version").alias("version"))
        return rows.join(newest, ["path", "version"], "left_semi").where("not gone").drop("gone", "version")

    def apply(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.batch:
            return
        _differences(self.modules(), changes).write.mode("overwrite").parquet(f"{self.folder}/version={batch}")
        self.deltas.append(batch)
        self.batch = batch
        if len([n for n in self.deltas if not self.whole or n > self.whole[-1]]) >= WHOLE_EVERY:
            self.modules().write.mode("overwrite").parquet(f"{self.folder}/whole={batch}")
            self.whole.append(batch)

    def build(self) -> metadata.Metadata:
        return metadata.build(self.modules())

    def updated(self, old: metadata.Metadata, before: DataFrame) -> metadata.Metadata:
        """The tables after changes to the modules `before`: where no model part changed, only modules and exports are new;
        else the rows of models that are not as they were are replaced, whatever made them so: their own module, a base, a relation or a re-export."""
        now = self.modules()
        paths = changes_of(model_part(before), model_part(now), "path").select("path")
        if paths.isEmpty():
            return metadata.refreshed(old, now)
        new = metadata.build(now)
        models = differing(old.models, new.models, "label")
        labels = metadata.stored(models.unionByName(differing(old.fields, new.fields, "model")).distinct())
        return metadata.Metadata(new.modules, new.exports, metadata.stored(replaced(old.models, new.models, labels, "label")), new.bases, metadata.stored(replaced(old.fields, new.fields, labels)))


def follow(changes: DataFrame, index: Index, checkpoint: str, after: Callable[[Index], None] | None = None) -> StreamingQuery:
    """Applies every micro-batch of a stream of CHANGE rows to index, and calls after."""

    def batch(df: DataFrame, number: int) -> None:
        index.apply(df, number)
        if after:
            after(index)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
