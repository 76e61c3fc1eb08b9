"""Data tests: each gives the rows that violate it; a suite counts them, (test, severity, failures, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gate import STATUSES
from .silver import CURRENCIES

SPEED_CEILING, AMOUNT_CEILING = 900, 100


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that stand more than once; nulls do not count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows with another value; null is accepted."""
    return df.where(~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null column has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def fails(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is not true; a null rule is a failure."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key).groupBy(key).agg(F.count("*").alias("n"))


def below_card_total(features: DataFrame) -> DataFrame:
    """Rows whose hourly count is not under their card's total, so that it may hold the row itself."""
    total = features.groupBy("card_id_hash").agg(F.count("*").alias("total"))
    return features.join(total, "card_id_hash").where("txn_count_1h >= total")


def normal_speed(features: DataFrame, auths: DataFrame, ceiling: float = SPEED_CEILING) -> DataFrame:
    """Ordinary rows too fast after an ordinary card-present row of the same file."""
    order = Window.partitionBy("card_id_hash").orderBy(F.unix_timestamp("event_time"), "event_time", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"previous_{c}": F.last(F.when(F.col("card_present"), F.col(c)), ignorenulls=True).over(order) for c in ("is_fraud", "_source_file")}
    audit = auths.withColumns(before).select("transaction_id", "_source_file", *before)
    rule = (F.col("is_fraud") == 0) & (F.col("implied_speed_kmh") > ceiling) & (F.col("previous_is_fraud") == 0) & (F.col("previous__source_file") == F.col("_source_file"))
    return features.join(audit, "transaction_id").where(rule)


def run_suite(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """name -> (severity, violating rows), counted."""
    rows = [bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), F.lit(severity).alias("severity"), "failures") for name, (severity, bad) in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("failures") == 0)


def suite(bronze: DataFrame, auths: DataFrame, settlements: DataFrame, quarantine: DataFrame, recon: DataFrame, features: DataFrame, history: DataFrame) -> DataFrame:
    """The tests of the card tables."""
    silver = auths.select("transaction_id").unionByName(settlements.select("transaction_id"))
    kept = silver.unionByName(quarantine.select("transaction_id"))
    mismatch = (F.col("is_break") & F.col("break_reason").isNotNull()) | (~F.col("is_break") & F.col("break_reason").isNull())
    return run_suite({
        "unique_transaction_id": ("error", unique(auths, "transaction_id")),
        "not_null_card_id_hash": ("error", not_null(auths, "card_id_hash")),
        "accepted_currency": ("error", accepted_values(auths, "currency", CURRENCIES)),
        "accepted_recon_status": ("error", accepted_values(recon, "recon_status", STATUSES)),
        "settlement_has_authorization": ("warn", relationships(settlements, "auth_transaction_id", auths, "transaction_id")),
        "break_reason_iff_break": ("error", fails(recon, mismatch)),
        "declined_is_no_break": ("error", recon.where("recon_status = 'AUTH_DECLINED' and is_break")),
        "matched_within_ceiling": ("error", recon.where(f"recon_status = 'MATCHED' and abs(amount_diff) > {AMOUNT_CEILING}")),
        "no_bronze_row_dropped": ("error", bronze.where("transaction_id is not null").select("transaction_id").join(kept, "transaction_id", "left_anti")),
        "no_history_no_recency": ("error", features.where("not has_history and (minutes_since_last_txn is not null or amount_avg_24h is not null)")),
        "normal_speed_within_ceiling": ("warn", normal_speed(features, auths)),
        "one_open_version": ("error", unique(history.where("valid_to is null"), "merchant_id")),
        "quarantine_disjoint": ("error", disjoint(quarantine.where("transaction_id is not null"), silver, "transaction_id")),
        "hourly_count_excludes_self": ("error", below_card_total(features)),
        "daily_not_less_than_hourly": ("error", features.where("txn_count_24h < txn_count_1h")),
    })


#: The channels.
CHANNELS = ("POS", "ONLINE", "ATM", "CONTACTLESS")


def column_suite(auths: DataFrame, settlements: DataFrame, quarantine: DataFrame, recon: DataFrame, features: DataFrame, history: DataFrame) -> DataFrame:
    """The tests that the tables' columns declare, (test, severity, failures, passed): what must be unique, filled, of a
    set or known. Tests of one column's rows are counted together, in one pass over the table."""
    filled = {
        "authorizations": (auths, ("transaction_id", "event_time", "card_id_hash")), "settlements": (settlements, ("transaction_id", "event_time", "card_id_hash", "auth_transaction_id")),
        "quarantine": (quarantine, ("quarantine_key", "quarantine_reasons", "quarantined_at")), "reconciliation": (recon, ("recon_key", "recon_status")),
        "features": (features, ("transaction_id", "card_id_hash", "event_time")), "merchants": (history, ("merchant_id", "valid_from")),
    }
    among = {"authorizations": {"currency": CURRENCIES, "channel": CHANNELS}, "settlements": {"currency": CURRENCIES}, "reconciliation": {"recon_status": STATUSES}}
    out = []
    for name, (df, columns) in filled.items():
        bad = {f"not_null_{name}_{c}": F.col(c).isNull() for c in columns} | {f"accepted_{name}_{c}": ~F.col(c).isin(*v) for c, v in among.get(name, {}).items()}
        counts = df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in bad.items()])
        out.append(counts.unpivot([], list(bad), "test", "failures").select("test", F.lit("error").alias("severity"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), (F.coalesce("failures", F.lit(0)) == 0).alias("passed")))
    keys = {"authorizations": "transaction_id", "settlements": "transaction_id", "quarantine": "quarantine_key", "reconciliation": "recon_key", "features": "transaction_id"}
    rest = {f"unique_{name}_{c}": ("error", unique(filled[name][0], c)) for name, c in keys.items()}
    rest["known_settlements_auth_transaction_id"] = ("warn", relationships(settlements, "auth_transaction_id", auths, "transaction_id"))
    return reduce(DataFrame.unionByName, [*out, run_suite(rest)])
