"""Row operators over file streams: the same expressions as in batch, with exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from molloom.sources.compounds import append_once


def run(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, sep: str = ",") -> StreamingQuery:
    """Reads the CSV files of a folder as they come, transforms their rows and appends them to Parquet; ends when no file is left.

    transform must be stateless (filters, scores against fixed queries, column transforms).
    """
    rows = spark.readStream.option("header", True).option("sep", sep).schema(schema).csv(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first(spark: SparkSession, source: str, schema: str, keys: list[str], target: str, checkpoint: str, sep: str = ",", files: int = 1) -> StreamingQuery:
    """Reads the CSV files of a folder as they come, so many a batch, and keeps the first row of each key over all batches.

    The keys seen are those in the target itself, and a batch that is replayed after a failure replaces its own files, so rows
    come exactly once however often it is started again.
    """
    rows = spark.readStream.option("header", True).option("sep", sep).option("maxFilesPerTrigger", files).schema(schema).csv(source)
    return rows.writeStream.foreachBatch(lambda df, batch: append_once(df, target, batch, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
