"""Usage counts and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpath.plans.metadata import stored


def usage(events: DataFrame, name: str, most: int = 500) -> DataFrame:
    """name, uses of the most used names."""
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "name").limit(most)


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, p50, p95, low, high of each group; a percentile is the value of rank floor(n * p) from 0, without interpolation.

    Different values are counted, dealt into ranges of (group, value) and counted on within a range; the rows
    before a range come from one row for each range and group. So a group of many values lies in many tasks.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(parts, group, "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(group, "_part").agg(F.sum("_n").alias("_rows"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    whole = sums.groupBy(F.col(group).alias("_g")).agg(F.sum("_rows").alias("count"), (F.sum("_sum") / F.sum("_rows")).alias("mean"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    key = F.col("_g").eqNullSafe(F.col(group))
    seen = F.sum("_n").over(Window.partitionBy(group, "_part").orderBy("_v"))
    offsets = sums.select(F.col(group).alias("_o"), F.col("_part").alias("_p"), "_before").join(whole, F.col("_g").eqNullSafe(F.col("_o"))).drop("_g")
    placed = ranged.withColumn("_seen", seen).join(offsets, F.col("_o").eqNullSafe(F.col(group)) & (F.col("_part") == F.col("_p")))
    last = F.col("_before") + F.col("_seen")

    def ranked(p: float) -> F.Column:
        at = F.least(F.floor(F.col("count") * p), F.col("count") - 1)
        return F.max(F.when((last > at) & (last - F.col("_n") <= at), F.col("_v").cast("double")))

    found = placed.groupBy(F.col(group).alias("_f")).agg(ranked(0.5).alias("p50"), ranked(0.95).alias("p95"))
    return whole.join(found, F.col("_g").eqNullSafe(F.col("_f"))).select(F.col("_g").alias(group), "count", "mean", "p50", "p95", "low", "high")


def recent(samples: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """The last `size` rows of each group by the columns of order. Every task keeps its own last ones before any are shuffled, so a group
    of any number of rows sends a bounded number."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order)))
    return samples.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def recent_latency(samples: DataFrame, group: str, value: str, order: list[str], size: int = 500) -> DataFrame:
    """As latency, over a ring buffer: the last `size` samples of each group that have a value."""
    kept = recent(samples.where(F.col(value).isNotNull()).select(group, value, *order), group, order, size)
    found = kept.groupBy(group).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("_all"))
    at = lambda p: F.get("_all", F.least(F.floor(F.col("count") * p), F.col("count") - 1).cast("int")).cast("double")
    return found.select(group, "count", "mean", at(0.5).alias("p50"), at(0.95).alias("p95"), F.array_min("_all").alias("low"), F.array_max("_all").alias("high"))


def gauges(events: DataFrame, name: str, time: str, value: str) -> DataFrame:
    """name, total, last: the sum of a counter and the latest value of a gauge."""
    return events.groupBy(name).agg(F.count("*").alias("total"), F.max_by(value, F.struct(time, value)).alias("last"))


def health(statistics: DataFrame, errors_allowed: float = 0.1) -> DataFrame:
    """statistics with phase: empty, degraded or ready."""
    phase = F.when(F.col("files") == 0, "empty").when(F.col("errors") > F.col("files") * errors_allowed, "degraded").otherwise("ready")
    return statistics.withColumn("phase", phase)
