"""Keyed upkeep of a table by a stream: batches merge into versions that can be told apart and replayed.

A version is a folder, named by the batch that wrote it; the table's head is the version of the highest complete batch. A batch
always merges into the newest version below its own number, so running it again, whole or
after a failure half way, gives the same rows. Spark's own commit marks a version complete.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import upsert


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, ascending."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = [int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n))]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS")))


def head(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest version's rows (of those below a number), None if there is none."""
    known = [n for n in versions(spark, path) if below is None or n < below]
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all complete versions but the newest `keep`, two at least: the last batch may run again."""
    jvm = spark.sparkContext._jvm
    for n in versions(spark, path)[: -max(2, keep)]:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def merge_batch(batch: DataFrame, number: int, path: str, key: str, keep: tuple[str, ...] = ()) -> None:
    """Writes version `number`: the one before it with the batch's rows merged in by `key`. Columns
    in `keep` stay as they first were."""
    old = head(batch.sparkSession, path, number)
    merged = upsert(old if old is not None else batch.limit(0), batch, key, keep)
    merged.write.mode("overwrite").parquet(f"{path}/version={number}")


def keep_up(stream: DataFrame, path: str, key: str, checkpoint: str, keep: tuple[str, ...] = ()) -> None:
    """Merges all that a stream has now into the table at `path`, a version for each batch; older versions go."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, key, keep)
        prune(batch.sparkSession, path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
