"""Audits of settlement drift, card movement, defects and merchant changes; the scored sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km


def settlement_drift(auths: DataFrame, settlements: DataFrame) -> DataFrame:
    """By category, how many approved and settled authorizations settled exactly, within 5 %, above or below."""
    s = settlements.select(F.col("auth_transaction_id").alias("transaction_id"), F.col("amount").alias("settled"))
    diff = F.col("settled") - F.col("amount")
    band = F.when(diff == 0, "exact").when(F.abs(diff) * 20 <= F.col("amount"), "small").when(diff > 0, "tip").otherwise("below")
    n = auths.where("auth_code = '00'").join(s, "transaction_id").groupBy("mcc", band.alias("band")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("mcc")))


def speed_audit(auths: DataFrame, limit: float = 900) -> DataFrame:
    """Authorizations that a card could reach only faster than `limit` km/h from its one before: in
    another country, or both with the card present. No time between two places is too fast."""
    w = Window.partitionBy("card_id_hash").orderBy("event_time", "transaction_id")
    was = F.lag(F.struct("country", "lat", "lon", "card_present", "event_time")).over(w)
    rows = auths.where("card_id_hash is not null").withColumn("was", was).where("was is not null")
    rows = rows.withColumns({
        "cross_country": F.col("was.country") != F.col("country"),
        "km": haversine_km(F.col("was.lat"), F.col("was.lon"), F.col("lat"), F.col("lon")),
        "hours": (F.unix_micros("event_time") - F.unix_micros("was.event_time")) / 3.6e9,
    })
    fast = rows.where((F.col("cross_country") | F.col("was.card_present") & F.col("card_present")) & (F.col("km") > limit * F.col("hours")))
    return fast.select("transaction_id", "cross_country", F.round("km", 3).alias("km"), F.round("hours", 4).alias("hours"))


def defects_by_file(quarantine: DataFrame) -> DataFrame:
    return quarantine.select("_source_file", F.explode("quarantine_reasons").alias("reason")).groupBy("_source_file", "reason").agg(F.count("*").alias("n"))


def merchant_drift(history: DataFrame) -> DataFrame:
    """Merchants of several versions, and which attribute changed; from or to null is no change."""
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"{c}_changed")
    return history.groupBy("merchant_id").agg(F.count("*").alias("versions"), differ("merchant_name"), differ("mcc")).where("merchant_name_changed or mcc_changed")


def scored_sample(flags: DataFrame, ordinary: int = 1000, seed: int = 42) -> DataFrame:
    """All fraud rows of the test split and `ordinary` others, the first by a hash of the id."""
    test = flags.where("split = 'test'")
    some = test.where("is_fraud = 0").orderBy(F.xxhash64("transaction_id", F.lit(seed)), "transaction_id").limit(ordinary)
    return test.where("is_fraud = 1").unionByName(some)


def model_recall(flags: DataFrame, types: DataFrame) -> DataFrame:
    """For each fraud_type of `types` how many rows the flags hold and the model's recall; none: null."""
    found = flags.where("is_fraud = 1").groupBy("fraud_type").agg(F.count("*").alias("n"), F.avg(F.col("model_flag").cast("int")).alias("model_recall"))
    return types.join(found, "fraud_type", "left").select("fraud_type", F.coalesce("n", F.lit(0)).alias("n"), "model_recall")


def labelled_breaks(recon: DataFrame) -> DataFrame:
    """recon_distribution with its flags as labels."""
    label = lambda c, yes, no: F.when(F.col(c), yes).otherwise(no)
    rows = recon.select("recon_status", label("is_break", "Break", "Clean").alias("outcome"), label("is_matured", "Matured", "Pending maturity").alias("maturity"))
    return rows.groupBy("recon_status", "outcome", "maturity").agg(F.count("*").alias("n"))


def lenient_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns as doubles; what is no number is null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
