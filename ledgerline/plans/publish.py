"""Build, gate and publish as one run: tables are built aside, and readers get them only if the gate passes.

A run writes each table once under its own folder, derives the gate from those stored tables, logs the verdict, and then either
moves the pointer to the run or leaves it. The pointer is a table of appended rows, the newest of which names the run that
readers see, so a failed or interrupted run never shows, and the run before stays readable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate, gate_log, incremental, merchants, reconcile, silver, velocity
from ..streaming.merge import versions

TABLES = ("authorizations", "settlements", "quarantine", "reconciliation", "features")


@dataclass(frozen=True)
class Outcome:
    run: str
    passed: bool
    logged: bool


def build(bronze: DataFrame, folder: str, as_of: str) -> dict[str, DataFrame]:
    """Each table written under `folder`, every one from the stored ones before it."""
    spark = bronze.sparkSession

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    out = {"authorizations": store("authorizations", silver.authorizations(bronze)), "settlements": store("settlements", silver.settlements(bronze)), "quarantine": store("quarantine", silver.quarantine(bronze, as_of))}
    out["reconciliation"] = store("reconciliation", reconcile.reconcile(out["authorizations"], out["settlements"], as_of))
    out["features"] = store("features", velocity.card_velocity_features(out["authorizations"]))
    return out


def pointer(spark: SparkSession, root: str, but: str | None = None) -> str | None:
    """The run that readers see, or would see if the run `but` had never been published."""
    if not versions(spark, f"{root}/published"):
        return None
    runs = spark.read.schema("run string, version int").parquet(f"{root}/published").where(~F.col("run").eqNullSafe(F.lit(but)))
    return runs.agg(F.max_by("run", "version")).first()[0]


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run that readers see; an error before any run has passed."""
    run = pointer(spark, root)
    if run is None:
        raise ValueError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/runs/{run}/{name}")


def publish(bronze: DataFrame, root: str, run: str, as_of: str, log: str) -> Outcome:
    """Builds the tables of `run`, gates them, logs the verdict and, if it passed, takes the merchants' snapshot and lets
    readers see the run. A run that is done again replaces its own tables and log rows."""
    spark, folder = bronze.sparkSession, f"{root}/runs/{run}"
    before = pointer(spark, root, run)
    tables = build(bronze, folder, as_of)
    tables["gate"] = gate.gate(tables["reconciliation"], tables["features"])
    tables["gate"].write.mode("overwrite").parquet(f"{folder}/gate")
    verdict = spark.read.parquet(f"{folder}/gate")
    logged = gate_log.append_once(verdict, log, as_of)
    if not verdict.where("not passed").isEmpty():
        return Outcome(run, False, logged)
    now = merchants.merchants_current(tables["authorizations"]).select(*merchants.COLUMNS)
    old = spark.read.parquet(f"{root}/runs/{before}/merchants") if before is not None else None
    incremental.snapshot(old, now, "merchant_id", ("merchant_name", "mcc"), as_of).write.mode("overwrite").parquet(f"{folder}/merchants")
    number = (versions(spark, f"{root}/published") or [-1])[-1] + 1
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.parquet(f"{root}/published/version={number}")
    return Outcome(run, True, logged)
