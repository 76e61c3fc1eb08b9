"""The quality gate: one row of metrics, seven expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("AUTH_DECLINED", "AMOUNT_MISMATCH", "MATCHED", "AUTH_NO_SETTLEMENT", "PENDING_SETTLEMENT", "ORPHAN_SETTLEMENT")
#: Metric -> (least, most, whether most itself fails).
BOUNDS = {
    "recon_row_count": (1.0, None, False),
    "recon_status_invalid_count": (0.0, 0.0, False),
    "matched_share_of_matured": (0.60, 0.98, False),
    "orphan_settlement_share": (0.0, 0.03, True),
    "fraud_rate": (0.005, 0.05, False),
    "p99_implied_speed_kmh_nonfraud": (0.0, 900.0, True),
    "velocity_inversion_count": (0.0, 0.0, False),
}


def count_if(c):
    return F.sum(F.when(c, 1).otherwise(0))


def gate(recon: DataFrame, features: DataFrame) -> DataFrame:
    """expectation, observed, passed (a null observation passes), overall_success."""
    matched = (F.col("recon_status") == "MATCHED") & F.col("is_matured")
    r = recon.agg(
        F.count("*").cast("double").alias("recon_row_count"), count_if(~F.col("recon_status").isin(*STATUSES)).cast("double").alias("recon_status_invalid_count"),
        (count_if(matched) / F.nullif(count_if(F.col("is_matured")), F.lit(0))).alias("matched_share_of_matured"),
        (count_if(F.col("recon_status") == "ORPHAN_SETTLEMENT") / F.nullif(F.count("*"), F.lit(0))).alias("orphan_settlement_share"),
    )
    v = features.agg(
        F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"), F.percentile_approx(F.when(F.col("is_fraud") == 0, F.col("implied_speed_kmh")), 0.99, 1_000_000).alias("p99_implied_speed_kmh_nonfraud"),
        count_if(F.col("txn_count_24h") < F.col("txn_count_1h")).cast("double").alias("velocity_inversion_count"),
    )
    rows = r.crossJoin(v).unpivot([], list(BOUNDS), "expectation", "observed")
    ok = F.lit(True)
    for name, (low, high, strict) in BOUNDS.items():
        o = F.col("observed")
        inside = o >= low
        if high is not None:
            inside = inside & (o < high if strict else o <= high)
        ok = F.when(F.col("expectation") == name, o.isNull() | inside).otherwise(ok)
    rows = rows.withColumn("passed", ok)
    return rows.crossJoin(rows.agg(F.min("passed").alias("overall_success")))
