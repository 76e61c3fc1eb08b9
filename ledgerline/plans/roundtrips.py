"""Queries that write, read back and compare: sinks, loads, tables, views and the gate's log over the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate_log
from ..sources.events import EVENT_SCHEMA, read_events
from ..sources.tables import overwrite_table, shared_folder, view, write_interval
from ..streaming.ingest import load_new_files

#: The names of an event record's fields.
FIELDS = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]


def as_records(bronze: DataFrame) -> DataFrame:
    return bronze.select(*FIELDS, "_ingested_at")


def interval_files(bronze: DataFrame) -> DataFrame:
    """Events and amounts by interval, after two intervals were written, one of them twice with other rows at
    first, and one that is empty."""
    spark, path = bronze.sparkSession, shared_folder(bronze.sparkSession, "intervals")
    rows = as_records(bronze)
    early, late = rows.where("_ingested_at < timestamp '2024-01-20'"), rows.where("_ingested_at >= timestamp '2024-01-20'")
    wrote = [write_interval(df, path, name) for df, name in ((early.limit(7), "i1"), (early, "i1"), (rows.where("false"), "i2"), (late, "i3"))]
    back = spark.read.schema(f"{EVENT_SCHEMA}, _ingested_at timestamp, interval string").parquet(path)
    counts = back.groupBy("interval").agg(F.count("*").alias("n"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))
    return counts.withColumn("empty_written", F.lit(wrote[2]))


def loaded_once(bronze: DataFrame) -> DataFrame:
    """Events by kind after a stream loaded a folder, nothing new, and one more file."""
    spark = bronze.sparkSession
    inbox, target, checkpoint = (shared_folder(spark, f"load-{n}") for n in ("inbox", "target", "checkpoint"))
    rows = bronze.select(*FIELDS, "_source_file")
    rows.where("_source_file = 'batch_1.parquet'").drop("_source_file").write.parquet(f"{inbox}")
    for _ in range(2):
        load_new_files(spark, inbox, target, checkpoint)
    rows.where("_source_file <> 'batch_1.parquet'").drop("_source_file").write.mode("append").parquet(inbox)
    load_new_files(spark, inbox, target, checkpoint)
    found = read_events(spark, target)
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("transaction_id").alias("ids"))


def named_tables(recon: DataFrame) -> DataFrame:
    """Rows by status read through a view of a table that was refreshed over an older one."""
    import uuid

    name = f"recon_{uuid.uuid4().hex}"
    try:
        overwrite_table(recon.limit(3).select("recon_key", "recon_status"), name)
        table = overwrite_table(recon.select("recon_key", "recon_status", "is_break"), name)
        seen = view(table, f"{name}_view")
        rows = seen.groupBy("recon_status").agg(F.count("*").alias("n"), F.sum(F.col("is_break").cast("long")).alias("breaks")).collect()
        return recon.sparkSession.createDataFrame(rows, "recon_status string, n long, breaks long")
    finally:
        recon.sparkSession.sql(f"drop view if exists {name}_view")
        recon.sparkSession.sql(f"drop table if exists {name}")


def logged_gates(gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's newest runs, and the rows of the last, after three verdicts, one of which was logged twice."""
    path = shared_folder(gate.sparkSession, "gate-log")
    gate = gate.sparkSession.createDataFrame(gate.collect(), gate.schema)  # seven rows
    other = gate.withColumns({"passed": F.col("passed") & (F.col("expectation") != "recon_row_count"), "overall_success": F.lit(False)})
    for rows, at in ((gate, "2024-02-01 00:00:00"), (other, "2024-02-02 00:00:00"), (other, "2024-02-02 00:00:00"), (gate, "2024-02-03 00:00:00")):
        gate_log.append_once(rows, path, at)
    log = gate_log.read_log(gate.sparkSession, path)
    return gate_log.history(log, 2), gate_log.latest(log)


#: What each expectation says.
MEANINGS = {
    "recon_row_count": "the reconciliation has rows", "recon_status_invalid_count": "all statuses are known", "matched_share_of_matured": "matured rows match in the usual share",
    "orphan_settlement_share": "few settlements lack an authorization", "fraud_rate": "fraud is as frequent as usual", "p99_implied_speed_kmh_nonfraud": "ordinary cards move at possible speeds",
    "velocity_inversion_count": "no day has fewer transactions than its last hour",
}


def described(gate: DataFrame) -> DataFrame:
    """The gate's rows with what they mean, ordered by expectation."""
    said = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    return gate.withColumn("description", F.element_at(said, F.col("expectation"))).orderBy("expectation")


def display(flags: DataFrame, newest: int = 50) -> DataFrame:
    """The newest flagged rows as they are shown: a short card, flags as words, '-' for no fraud type."""
    word = lambda c: F.when(F.col(c), "Yes").otherwise("No").alias(c)
    top = flags.where("any_rule").orderBy(F.col("event_time").desc(), F.col("transaction_id").desc()).limit(newest)
    return top.select("transaction_id", F.substring("card_id_hash", 1, 12).alias("card"), "amount", *[word(f"rule_{n}") for n in ("velocity", "geo", "amount")], "rules_fired", F.coalesce("fraud_type", F.lit("-")).alias("fraud_type"))
