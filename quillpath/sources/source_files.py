"""Source files as rows: listing, fingerprints of files and of directories, versions for reuse."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold no project code.
SKIPPED = ("__pycache__", "node_modules", "venv", "env", "site-packages", "build", "dist", "migrations")


def _under(path: Column, root: str) -> Column:
    """path below root, with slashes and no scheme."""
    plain = F.regexp_replace(path, "^[a-z]+:/*", "/")
    return F.substr(plain, F.lit(len(re.sub("^[a-z]+:/*", "/", root).rstrip("/")) + 2))


def read_sources(spark: SparkSession, *roots: str, content: bool = True) -> DataFrame:
    """root, path (below root), size, mtime_us (and text) of all Python files below roots, hidden and skipped
    directories left out. A file below several roots is one of the first of them; equal paths below different roots are different files."""
    out, before = None, []
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
        plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
        for other in before:
            files = files.where(~plain.startswith(other))
        before.append(re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/")
        rows = files.select(F.lit(root).alias("root"), _under(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"), *([F.decode("content", "utf-8").alias("text")] if content else []))
        out = rows if out is None else out.unionByName(rows)
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return out.where(~F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED)))


def settings_choice(files: DataFrame) -> DataFrame:
    """entry, settings, n_candidates (one row): the entry script nearest to the root, and the settings module if there is exactly one candidate."""
    name = F.substring_index("path", "/", -1)
    depth = F.size(F.split("path", "/"))
    scripts = files.where(name == "manage.py").agg(F.min_by("path", F.struct(depth, "path")).alias("entry"))
    candidate = (name == "settings.py") | F.substring_index("path", "/", -2).rlike("^settings/[^_/][^/]*[.]py$")
    found = files.where(candidate).agg(F.count("*").alias("n_candidates"), F.min("path").alias("_only"))
    return scripts.crossJoin(found).select("entry", F.when(F.col("n_candidates") == 1, F.replace(F.regexp_replace("_only", "[.]py$", ""), F.lit("/"), F.lit("."))).alias("settings"), "n_candidates")


def fingerprinted(files: DataFrame) -> DataFrame:
    """Adds fingerprint: SHA-256 of path, a zero byte, size, a colon and mtime."""
    return files.withColumn("fingerprint", F.sha2(F.concat("path", F.lit("\0"), F.col("size").cast("string"), F.lit(":"), F.col("mtime_us").cast("string")).cast("binary"), 256))


def directory_fingerprints(files: DataFrame) -> DataFrame:
    """path, fingerprint of all directories, from the deepest up: the SHA-256 of the sorted names and
    fingerprints of what is in each. One grouping for each level of depth; "" is the root."""
    parts = F.split("path", "/")
    nodes = files.select("path", "fingerprint", (F.size(parts) - 1).alias("depth"))
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = None
    waiting = nodes
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = waiting.where(F.col("depth") == depth)
        parent = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/") if depth else F.lit("")
        made = here.groupBy(parent.alias("dir")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("\0"), "fingerprint"))), "\n").cast("binary"), 256).alias("fingerprint")).withColumnRenamed("dir", "path")
        done = made if done is None else done.unionByName(made)
        waiting = waiting.unionByName(made.where("path <> ''").withColumn("depth", F.lit(depth - 1)))
    return done if done is not None else files.select("path", "fingerprint").limit(0)


def changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "fingerprint") -> DataFrame:
    """key, change (added, removed, changed) of rows that differ between two versions."""
    a, b = old.select(key, F.col(mark).alias("was")), new.select(key, F.col(mark).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
