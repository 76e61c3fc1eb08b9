"""The log of gate verdicts: appended rows, their history, and the latest run."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gate import count_if

#: The log's schema.
SCHEMA = "checked_at timestamp, expectation string, observed double, passed boolean, overall_success boolean"


def read_or_empty(spark: SparkSession, table: str, schema: str = SCHEMA) -> DataFrame:
    """The named table, or no rows of its schema where it is missing."""
    return spark.read.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], schema)


def append_verdict(gate: DataFrame, table: str, checked_at: str) -> None:
    """Appends one run's rows, all with one checked_at; NaN observations become null."""
    rows = gate.select(F.lit(checked_at).cast("timestamp").alias("checked_at"), "expectation", F.nanvl("observed", F.lit(None).cast("double")).alias("observed"), "passed", "overall_success")
    rows.write.mode("append").saveAsTable(table)


def append_once(gate: DataFrame, path: str, checked_at: str) -> bool:
    """Writes one run's rows to the log at `path`, in place of those of the same checked_at, and tells whether that
    went well: a log that cannot be written is reported, and the verdict stands without it."""
    at = F.lit(checked_at).cast("timestamp")
    rows = gate.select(at.alias("checked_at"), "expectation", F.nanvl("observed", F.lit(None).cast("double")).alias("observed"), "passed", "overall_success", F.date_format(at, "yyyyMMddHHmmss").alias("run"))
    try:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        logging.getLogger(__name__).warning("the gate's verdict of %s was not logged at %s: %s", checked_at, path, str(e).partition("\n")[0])
        return False
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `append_once` wrote, in the log's schema."""
    return spark.read.schema(f"{SCHEMA}, run string").parquet(path).drop("run")


def history(log: DataFrame, newest: int = 20) -> DataFrame:
    """checked_at, success and failed expectations of the newest runs."""
    runs = log.groupBy("checked_at").agg(F.max("overall_success").alias("success"), count_if(~F.col("passed")).alias("failed"))
    return runs.orderBy(F.col("checked_at").desc()).limit(newest)


def latest(log: DataFrame) -> DataFrame:
    """The rows of the newest run, ordered by expectation."""
    last = log.agg(F.max("checked_at").alias("checked_at"))
    return log.join(F.broadcast(last), "checked_at").orderBy("expectation")


def gated(gate: DataFrame, then) -> bool:
    """Calls `then` if all expectations passed, so that what follows a failed gate is not built."""
    ok = gate.where("not passed").isEmpty()
    if ok:
        then()
    return ok
