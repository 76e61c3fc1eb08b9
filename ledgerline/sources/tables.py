"""Slices of a message log, interval batches, and named tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def between(messages: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """The messages with start <= ts < end; neighbouring slices share and miss none."""
    return messages.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def write_interval(events: DataFrame, path: str, interval: str) -> bool:
    """Writes the events of one interval in event_time order, in place of what an earlier attempt
    left; other intervals stay. Without events nothing is written and the result is False."""
    if events.isEmpty():
        return False
    rows = events.withColumn("interval", F.lit(interval)).sortWithinPartitions("event_time")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval").parquet(path)
    return True


def overwrite_table(df: DataFrame, name: str) -> DataFrame:
    """Full refresh of a named table, which is returned."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.read.table(name)


def view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.read.table(name)


def materialise(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """Each frame as a refreshed table, so that later reads do not derive it again."""
    return {name: overwrite_table(df, prefix + name) for name, df in tables.items()}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; a session on one
    machine without that setting gets a temporary folder. Whoever owns the folder clears it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, written to the shared folder once and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
