"""A folder of Parquet files, followed into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillpath.sources.versioned import VersionedTable


def follow_files(spark: SparkSession, folder: str, schema: StructType, table: VersionedTable, checkpoint: str, stream: str = "files", max_files: int = 1, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Adds the rows of files that are new in folder to table, at most max_files of them in a batch, after change.

    A batch is in the table once: its number is in the manifest of the version that adds it. A run that is killed before that
    leaves only files that no version names, one that is killed after it is found to be done when the stream runs the batch again with the same
    files. Ends when all files there are in the table.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        table.append(change(df) if change else df, stream, number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
