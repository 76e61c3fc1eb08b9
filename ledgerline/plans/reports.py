"""Reports over the Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gate import count_if


def distribution(recon: DataFrame) -> DataFrame:
    """Rows by status, the most frequent first."""
    return recon.groupBy("recon_status", "is_break", "is_matured").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recon_status", "is_break", "is_matured")


def break_summary(recon: DataFrame) -> DataFrame:
    return recon.agg(F.count("*").alias("total"), count_if(F.col("is_break")).alias("breaks"), (count_if(F.col("is_break")) / F.nullif(F.count("*"), F.lit(0))).alias("break_rate"))


def recall_by_type(flags: DataFrame) -> DataFrame:
    return flags.where("is_fraud = 1").groupBy("fraud_type").agg(F.count("*").alias("n"), F.avg(F.col("any_rule").cast("int")).alias("rules_recall"))


def confusion(flags: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and false positive rate of each rule and of any rule."""
    return confusion_of(flags, ["rule_velocity", "rule_geo", "rule_amount", "any_rule"])


def confusion_of(flags: DataFrame, strategies: list[str]) -> DataFrame:
    long = flags.unpivot(["is_fraud"], strategies, "strategy", "flag")
    f, y = F.col("flag"), F.col("is_fraud") == 1
    out = long.groupBy("strategy").agg(count_if(f & y).alias("tp"), count_if(f & ~y).alias("fp"), count_if(~f & y).alias("fn"), count_if(~f & ~y).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return out.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn"), "fpr": rate("fp", "tn")})


def daily_volume(auths: DataFrame, settlements: DataFrame) -> DataFrame:
    both = auths.select("event_time", "event_type").unionByName(settlements.select("event_time", "event_type"))
    return both.groupBy(F.to_date("event_time").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n")).orderBy("day", "event_type")


def daily_quarantine(auths: DataFrame, settlements: DataFrame, quarantine: DataFrame) -> DataFrame:
    day = F.to_date("_ingested_at").cast("string").alias("day")
    clean = auths.select("_ingested_at").unionByName(settlements.select("_ingested_at")).groupBy(day).agg(F.count("*").alias("c"))
    bad = quarantine.groupBy(day).agg(F.count("*").alias("b"))
    c, b = F.coalesce("c", F.lit(0)), F.coalesce("b", F.lit(0))
    return clean.join(bad, "day", "full_outer").select("day", c.alias("clean"), b.alias("quarantined"), (b / (b + c)).alias("quarantine_rate")).orderBy("day")


def latest_flagged(flags: DataFrame, n: int = 50) -> DataFrame:
    return flags.where("any_rule").orderBy(F.col("event_time").desc(), F.col("transaction_id").desc()).limit(n).select("transaction_id", F.substring("card_id_hash", 1, 12).alias("card"), "rules_fired", F.coalesce("fraud_type", F.lit("-")).alias("fraud_type"))
