"""Intermediate tables in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session (as in tests) may leave that unset: then it lies
    below the warehouse; on a cluster this raises, as a folder of one machine would lose tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    _made.append(f"{base.rstrip('/')}/molloom-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Written to a shared folder and read again: cuts the lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes all folders that this process made; for when the results that read them are written. Returns their number."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
