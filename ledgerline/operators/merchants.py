"""The current merchant dimension, and the version valid at a transaction's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .incremental import snapshot

COLUMNS = ("merchant_id", "merchant_name", "mcc", "mcc_description", "country")


def merchants_current(auths: DataFrame) -> DataFrame:
    """The latest row of each merchant; max_by combines before the shuffle, so a hot merchant
    sends one row from each task."""
    latest = F.max_by(F.struct(*COLUMNS[1:], F.col("event_time").alias("last_seen_at")), F.struct("event_time", "transaction_id"))
    return auths.where("merchant_id is not null").groupBy("merchant_id").agg(latest.alias("r")).select("merchant_id", "r.*")


def merchant_history(auths: DataFrame) -> DataFrame:
    """Two batches' snapshots: what the first held, then changes of name or category."""
    one = merchants_current(auths.where("_source_file = 'batch_1.parquet'")).select(*COLUMNS)
    two = merchants_current(auths).select(*COLUMNS)
    first = snapshot(None, one, "merchant_id", ("merchant_name", "mcc"), "2024-01-16 00:00:00")
    return snapshot(first, two, "merchant_id", ("merchant_name", "mcc"), "2024-02-01 00:00:00")


def as_of(auths: DataFrame, history: DataFrame) -> DataFrame:
    """Each transaction with the merchant version valid at its time (none: null)."""
    h = history.select(F.col("merchant_id").alias("h_id"), F.col("merchant_name").alias("version_name"), "valid_from", "valid_to")
    valid = (F.col("event_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("event_time") < F.col("valid_to")))
    return auths.join(h, (F.col("merchant_id") == F.col("h_id")) & valid, "left").drop("h_id")


def as_of_pass(auths: DataFrame, history: DataFrame, bucket: int = 86400) -> DataFrame:
    """The rows of `as_of` for histories of any length: versions and transactions in one ordered pass for
    each merchant and bucket of time. A version reaches the buckets after its own by a pass over one row
    for each merchant and bucket, so a hot merchant is cut by time and no range condition joins. Versions of a
    merchant must not overlap, as type-2 histories do not; a null time or merchant has no version."""
    rows = auths.select(F.col("merchant_id").alias("m"), F.col("event_time").alias("t"), F.lit(1).alias("side"), F.struct(*auths.columns).alias("row"), F.lit(None).cast("struct<version_name:string,valid_from:timestamp,valid_to:timestamp>").alias("v"))
    versions = history.select(F.col("merchant_id").alias("m"), F.col("valid_from").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct(F.col("merchant_name").alias("version_name"), "valid_from", "valid_to").alias("v"))
    both = rows.unionByName(versions.where("m is not null")).withColumn("bucket", F.floor(F.unix_seconds("t") / bucket))
    key = ["m", "bucket"]
    stamped = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    per = both.groupBy(*key).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("t"))).alias("newest"))
    before = F.last("newest", ignorenulls=True).over(Window.partitionBy("m").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = per.select(F.col("m").alias("m_"), F.col("bucket").alias("bucket_"), before.alias("carried"))
    met = both.join(carried, F.col("m").eqNullSafe(F.col("m_")) & F.col("bucket").eqNullSafe(F.col("bucket_")))
    own = F.last(stamped, ignorenulls=True).over(Window.partitionBy(*key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("found", F.coalesce(own["v"], F.col("carried"))).where("side = 1")
    valid = F.col("row.merchant_id").isNotNull() & (F.col("found.valid_to").isNull() | (F.col("t") < F.col("found.valid_to")))
    pick = lambda c: F.when(valid, F.col(f"found.{c}")).alias(c)
    return met.select("row.*", pick("version_name"), pick("valid_from"), pick("valid_to"))
