"""Bounded reads of a partitioned message log: from the offsets of one time to those of another.

An offset of a time is, in each partition, that of the first message whose timestamp is not before it,
and the high watermark (one beyond the last message) where there is none. Offsets grow in a partition,
timestamps need not: neighbouring slices are cut by offset, so they share no message and miss none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_of(messages: DataFrame, partition: Column) -> DataFrame:
    """A log (partition, offset, timestamp, key, value) of messages (key, value, timestamp, position): in
    each partition offsets count the messages in the order of their positions, which are unique."""
    order = Window.partitionBy("partition").orderBy("position")
    return messages.withColumn("partition", partition.cast("int")).withColumn("offset", F.row_number().over(order).cast("long") - 1).select("partition", "offset", "timestamp", "key", "value")


def offsets_at(log: DataFrame, time: str) -> DataFrame:
    """(partition, offset): where to read from for messages since `time`. One aggregation, combined in tasks."""
    at = F.lit(time).cast("timestamp")
    first = F.min(F.when(F.col("timestamp") >= at, F.col("offset")))
    return log.groupBy("partition").agg(F.coalesce(first, F.max("offset") + 1).alias("offset"))


def topic_slice(log: DataFrame, start: str, end: str) -> DataFrame:
    """The log's messages from the offsets at `start` to before those at `end`. One row for each
    partition of the topic is broadcast."""
    a = offsets_at(log, start).select(F.col("partition").alias("p"), F.col("offset").alias("lo"))
    b = offsets_at(log, end).select(F.col("partition").alias("q"), F.col("offset").alias("hi"))
    ends = a.join(b, F.col("p") == F.col("q")).select("p", "lo", "hi")
    inside = (F.col("partition") == F.col("p")) & (F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi"))
    return log.join(F.broadcast(ends), inside).select(*log.columns)
