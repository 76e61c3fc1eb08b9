"""Validity reasons, the typed Silver tables, and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
CURRENCIES = ("SGD", "MYR", "IDR", "THB", "USD", "GBP", "AUD")
EVENT_TYPES = ("AUTH", "SETTLEMENT")
KEY_COLUMNS = ("transaction_id", "event_type", "event_time", "card_id", "merchant_id", "amount", "currency", "_source_file")


def event_time() -> Column:
    return F.col("event_time").try_cast("timestamp")


def amount() -> Column:
    """Null where the amount is beyond decimal(12,2)."""
    return F.col("amount").try_cast("decimal(12,2)")


def reasons() -> Column:
    """Names of the checks that a row fails, in declared order; never null."""
    checks = {
        "NULL_TRANSACTION_ID": F.col("transaction_id").isNull(),
        "NULL_CARD_ID": F.col("card_id").isNull(),
        "NONPOSITIVE_AMOUNT": F.col("amount").isNull() | (F.col("amount") <= 0),
        "UNKNOWN_CURRENCY": F.col("currency").isNull() | ~F.col("currency").isin(*CURRENCIES),
        "UNPARSEABLE_EVENT_TIME": event_time().isNull(),
        "UNKNOWN_EVENT_TYPE": F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES),
        "AMOUNT_OVERFLOW": F.col("amount").isNotNull() & amount().isNull(),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def typed(events: DataFrame, kind: str, extra: list[str]) -> DataFrame:
    rows = events.where((F.col("event_type") == kind) & (F.size(reasons()) == 0))
    return rows.select(
        "transaction_id", "event_type", event_time().alias("event_time"), *(["auth_transaction_id"] if kind == "SETTLEMENT" else []),
        F.sha2("card_id", 256).alias("card_id_hash"), "merchant_id", "merchant_name", "mcc", "mcc_description",
        amount().alias("amount"), "currency", "country", *extra, "_ingested_at", "_source_file", "is_fraud", "fraud_type",
    )


def authorizations(events: DataFrame) -> DataFrame:
    return typed(events, "AUTH", ["lat", "lon", "channel", "pos_entry_mode", "card_present", "auth_code"])


def settlements(events: DataFrame) -> DataFrame:
    return typed(events, "SETTLEMENT", [])


def quarantine(events: DataFrame, as_of: str) -> DataFrame:
    key = F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_COLUMNS]), 256)
    bad = events.withColumn("quarantine_reasons", reasons()).where(F.size("quarantine_reasons") > 0)
    rest = [c for c in events.columns if c != "card_id"]
    return bad.select(key.alias("quarantine_key"), "quarantine_reasons", F.lit(as_of).cast("timestamp").alias("quarantined_at"), F.sha2("card_id", 256).alias("card_id_hash"), *rest)
