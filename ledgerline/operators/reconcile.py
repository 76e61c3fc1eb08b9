"""Reconciliation of authorizations with settlements: one full outer join on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, CEILING, FLOOR, MATURITY_MINUTES = 0.10, 100.0, 1.0, 10080
BREAKS = ("AMOUNT_MISMATCH", "AUTH_NO_SETTLEMENT", "ORPHAN_SETTLEMENT")


def reconcile(auths: DataFrame, settlements: DataFrame, as_of: str, tolerance: float = TOLERANCE, ceiling: float = CEILING, maturity: int = MATURITY_MINUTES) -> DataFrame:
    a = auths.select(F.col("transaction_id").alias("auth_transaction_id"), F.col("card_id_hash").alias("a_card"), F.col("amount").alias("auth_amount"), F.col("event_time").alias("auth_time"), "auth_code")
    s = settlements.select(F.col("auth_transaction_id").alias("of"), F.col("transaction_id").alias("settlement_transaction_id"), F.col("card_id_hash").alias("s_card"), F.col("amount").alias("settlement_amount"), F.col("event_time").alias("settlement_time"))
    both = a.join(s, F.col("auth_transaction_id") == F.col("of"), "full_outer")
    diff = F.col("settlement_amount") - F.col("auth_amount")
    has_auth, has_settlement = F.col("auth_transaction_id").isNotNull(), F.col("settlement_transaction_id").isNotNull()
    both = both.withColumns({
        "amount_diff": diff,
        "amount_diff_pct": diff / F.nullif("auth_amount", F.lit(0).cast("decimal(12,2)")),
        "is_matured": F.col("auth_time").isNotNull() & (F.col("auth_time") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(maturity))),
    })
    both = both.withColumns({"pct": (F.abs("amount_diff") > FLOOR) & (F.abs("amount_diff_pct") > tolerance), "over": F.abs("amount_diff") > ceiling})
    status = (
        F.when(has_auth & (F.col("auth_code") != "00"), "AUTH_DECLINED")
        .when(has_auth & has_settlement, F.when(F.col("pct") | F.col("over"), "AMOUNT_MISMATCH").otherwise("MATCHED"))
        .when(has_auth, F.when(F.col("is_matured"), "AUTH_NO_SETTLEMENT").otherwise("PENDING_SETTLEMENT"))
        .otherwise("ORPHAN_SETTLEMENT")
    )
    mismatch = F.col("recon_status") == "AMOUNT_MISMATCH"
    reason = (
        F.when(mismatch & F.col("pct") & F.col("over"), "PCT_AND_CEILING").when(mismatch & F.col("pct"), "PCT_EXCEEDED").when(mismatch, "CEILING_EXCEEDED")
        .when(F.col("recon_status") == "AUTH_NO_SETTLEMENT", "SETTLEMENT_TIMEOUT").when(F.col("recon_status") == "ORPHAN_SETTLEMENT", "NO_MATCHING_AUTH")
    )
    return both.withColumn("recon_status", status).select(
        F.coalesce("auth_transaction_id", "settlement_transaction_id").alias("recon_key"), "auth_transaction_id", "settlement_transaction_id",
        F.coalesce("a_card", "s_card").alias("card_id_hash"), "auth_amount", "settlement_amount", "amount_diff", "amount_diff_pct", "auth_time", "settlement_time",
        F.timestamp_diff("MINUTE", "auth_time", "settlement_time").alias("settlement_lag_minutes"), "recon_status",
        F.col("recon_status").isin(*BREAKS).alias("is_break"), reason.alias("break_reason"), "is_matured",
    )
