"""Rolling features per card: one shuffle on the card, all windows over its time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km

HIGH_RISK_MCC = ("5967", "5732", "4511")
#: Rules that flag a row if the feature is above the bound.
RULES = {"velocity": ("txn_count_1h", 2), "geo": ("implied_speed_kmh", 1500), "amount": ("amount_vs_avg_24h_ratio", 15)}


def card_velocity_features(auths: DataFrame) -> DataFrame:
    order = Window.partitionBy("card_id_hash").orderBy("u")
    hour, day = order.rangeBetween(-3600, 0), order.rangeBetween(-86400, 0)
    ever, before = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(-86400, -1)
    at = Window.partitionBy("card_id_hash").orderBy("u", "event_time", "transaction_id")
    present = at.rowsBetween(Window.unboundedPreceding, -1)
    last = {f"p_{c}": F.last(F.when(F.col("card_present"), F.col(c)), ignorenulls=True).over(present) for c in ("u", "lat", "lon")}
    rows = auths.withColumn("u", F.unix_timestamp("event_time")).withColumns({
        "n1": F.count("*").over(hour) - 1, "n24": F.count("*").over(day) - 1, "s24": F.sum("amount").over(day) - F.col("amount"),
        "n": F.count("*").over(ever) - 1, "countries": F.size(F.collect_set("country").over(before)), "prev": F.lag("u").over(at), **last,
    })
    return features_of(rows)


def features_of(rows: DataFrame) -> DataFrame:
    """The feature columns, from each row's counts n1, n24, n and sum s24, its countries, and the rows before it."""
    average = F.when(F.col("n24") > 0, F.col("s24").cast("double") / F.col("n24"))
    speed = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) / F.nullif((F.col("u") - F.col("p_u")) / F.lit(3600.0), F.lit(0.0))
    return rows.select(
        "transaction_id", "card_id_hash", "event_time", "amount", F.col("n1").alias("txn_count_1h"), F.col("n24").alias("txn_count_24h"), F.col("s24").alias("amount_sum_24h"),
        average.alias("amount_avg_24h"), (F.col("amount").cast("double") / F.nullif(average, F.lit(0.0))).alias("amount_vs_avg_24h_ratio"),
        F.col("countries").cast("long").alias("distinct_countries_24h"), ((F.col("u") - F.col("prev")) / F.lit(60.0)).alias("minutes_since_last_txn"),
        F.when(F.col("card_present") & F.col("p_u").isNotNull(), speed).alias("implied_speed_kmh"), F.col("card_present").alias("is_card_present"),
        (F.col("channel") == "ONLINE").alias("is_online"), F.col("mcc").isin(*HIGH_RISK_MCC).alias("is_high_risk_mcc"), (F.col("auth_code") != "00").alias("was_declined"),
        (F.col("n") > 0).alias("has_history"), "is_fraud", "fraud_type",
    )


def rule_flags(features: DataFrame) -> DataFrame:
    """One flag for each rule (null counts as not above), any_rule, and the fired rules' names."""
    flags = {f"rule_{name}": F.coalesce(F.col(c) > bound, F.lit(False)) for name, (c, bound) in RULES.items()}
    out = features.withColumns(flags)
    fired = F.concat_ws(", ", *[F.when(F.col(f"rule_{n}"), F.lit(n)) for n in RULES])
    return out.withColumns({"any_rule": F.greatest(*flags), "rules_fired": F.coalesce(F.nullif(fired, F.lit("")), F.lit("-"))})
