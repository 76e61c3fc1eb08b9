"""The anomaly model as a stored table, the contract of its inputs, and its promotion.

A model's rows are the nodes of its trees; each carries the version, the features in the order in which they were read, the
cutoff that flags, the size of a tree's sample, and the medians that stand in for missing values. Versions of a
table stand side by side, each in a partition that is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import evaluation
from .quantiles import exact_quantiles
from .velocity import rule_flags

NODES = ("tree", "node", "feature", "cut", "left", "right", "length")
FEATURES = (*evaluation.NUMERIC, *evaluation.BOOLEAN)
#: The features for which the training rows' medians stand in.
FILLED = ("minutes_since_last_txn", "amount_avg_24h")
#: Fraud types of which the model must find a share, and the least precision.
FLOOR_PRECISION, FLOOR_RECALL = 0.05, {"velocity": 0.50, "geo_impossible": 0.50}


@dataclass(frozen=True)
class Model:
    nodes: DataFrame
    version: str
    features: tuple[str, ...]
    cutoff: float
    sample: int
    medians: dict[str, float]


def sample_size(n: int, most: int = evaluation.SAMPLE) -> int:
    """Rows a tree grows on: all of a small training set."""
    return max(1, min(most, n))


def train(rows: DataFrame, version: str, trees: int = evaluation.TREES, contamination: float = evaluation.CONTAMINATION) -> Model:
    """A model of the training rows (card features; pass a stored frame, it is read for the medians, the trees and the cutoff)."""
    return train_and_score(rows, F.lit(True), version, trees, contamination)[0]


def train_and_score(rows: DataFrame, of: Column, version: str, trees: int = evaluation.TREES, contamination: float = evaluation.CONTAMINATION) -> tuple[Model, DataFrame]:
    """A model of the rows where `of` holds, and all rows, imputed, with their anomaly_score (stored). Each row is scored
    once, as the scores of the training rows give the cutoff too. Pass a stored frame."""
    own = rows.where(of)
    found = {c: exact_quantiles(own, c, (0.5,))[0] for c in FILLED}
    medians = {c: v for c, v in found.items() if v is not None}
    filled = evaluation.impute(rows, fill_of(rows.sparkSession, medians))
    size = sample_size(own.count())
    nodes = stored(evaluation.fit(filled.where(of), trees, size), "nodes")
    scores = stored(evaluation.score(filled, nodes, size), "scores")
    return Model(nodes, version, FEATURES, evaluation.cutoff(scores.where(of), contamination), size, medians), scores


def fill_of(spark: SparkSession, medians: dict[str, float]) -> DataFrame:
    """One row: the medians, null where there are none."""
    return spark.createDataFrame([tuple(float(medians[c]) if c in medians else None for c in FILLED)], ", ".join(f"{c} double" for c in FILLED))


def save(model: Model, path: str) -> None:
    """Writes the model as the partition of its version, in place of what a failed attempt left there."""
    rows = model.nodes.select(
        *NODES, F.array(*[F.lit(c) for c in model.features]).alias("features"), F.lit(model.cutoff).alias("cutoff"), F.lit(model.sample).alias("sample"),
        F.create_map(*[F.lit(x) for pair in sorted(model.medians.items()) for x in pair]).cast("map<string,double>").alias("medians"), F.lit(model.version).alias("version"),
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


SCHEMA = "tree int, node int, feature int, cut double, left int, right int, length double, features array<string>, cutoff double, sample int, medians map<string,double>, version string"


def load(spark: SparkSession, path: str, version: str | None = None) -> Model:
    """The named version, or that last in name; an error if it is not there."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    name = version or rows.agg(F.max("version")).first()[0]
    own = rows.where(F.col("version") == F.lit(name))
    about = own.select("features", "cutoff", "sample", "medians").first()
    if about is None:
        raise ValueError(f"no model {name or ''} at {path}")
    return Model(own.select(*NODES), name, tuple(about["features"]), about["cutoff"], about["sample"], about["medians"])


def checked(model: Model, features: tuple[str, ...] = FEATURES) -> Model:
    """The model, if it reads these features in this order: another order would score wrong columns without an error."""
    if model.features != tuple(features):
        raise ValueError(f"model {model.version} reads {model.features}, not {tuple(features)}")
    return model


def with_contract(df: DataFrame) -> DataFrame:
    """df with `rejected_for`: the features that are null or NaN, in the model's order, so that no value is made up for
    them. A column that is missing altogether is an error, as is one that is no number."""
    kinds = dict(df.dtypes)
    wrong = [c for c in FEATURES if c not in kinds] + [c for c in evaluation.BOOLEAN if kinds.get(c, "boolean") != "boolean"]
    wrong += [c for c in evaluation.NUMERIC if c in kinds and not number(kinds[c])]
    if wrong:
        raise ValueError(f"features missing or of another type: {wrong}")
    empty = lambda c: F.col(c).isNull() | (F.isnan(F.col(c).cast("double")) if c in evaluation.NUMERIC else F.lit(False))
    return df.withColumn("rejected_for", F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in FEATURES])))


def number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def accepted(df: DataFrame) -> DataFrame:
    return with_contract(df).where(F.size("rejected_for") == 0).drop("rejected_for")


def rejected(df: DataFrame) -> DataFrame:
    return with_contract(df).where(F.size("rejected_for") > 0)


def imputed(df: DataFrame, model: Model) -> DataFrame:
    """df with the medians that the model was trained with, and its other stand-ins."""
    return evaluation.impute(df, fill_of(df.sparkSession, model.medians))


def scored(df: DataFrame, model: Model, scored_at: Column | None = None) -> DataFrame:
    """df, batch or stream, whose rows keep the contract, with anomaly_score, model_flag, the rules' flags (on the raw
    values), combined_flag, model_version and scored_at."""
    return flagged(evaluation.score(df, checked(model).nodes, model.sample), model, scored_at)


def flagged(scores: DataFrame, model: Model, scored_at: Column | None = None) -> DataFrame:
    """Scored rows with the columns that `scored` adds to their anomaly_score."""
    out = evaluation.flag(scores, checked(model).cutoff)
    return out.withColumns({"model_version": F.lit(model.version), "scored_at": F.current_timestamp() if scored_at is None else scored_at})


def recall_three_ways(flags: DataFrame, types: DataFrame) -> DataFrame:
    """(fraud_type, n, rules_recall, model_recall, combined_recall) for each of `types`; none found: null rates."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    found = flags.where("is_fraud = 1").groupBy("fraud_type").agg(F.count("*").alias("n"), rate("any_rule").alias("rules_recall"), rate("model_flag").alias("model_recall"), rate("combined_flag").alias("combined_recall"))
    return types.join(found, "fraud_type", "left").select("fraud_type", F.coalesce("n", F.lit(0)).alias("n"), "rules_recall", "model_recall", "combined_recall")


def provenance(flags: DataFrame) -> DataFrame:
    """flags with the columns of the stored sample of scored rows."""
    return flags.select(
        "transaction_id", "card_id_hash", "event_time", "amount", "is_fraud", "fraud_type", "anomaly_score", F.col("model_flag").alias("predicted_fraud"),
        F.col("any_rule").alias("rule_flag"), "combined_flag", F.lit("isolation_forest").alias("model_name"), "model_version", F.col("scored_at").alias("run"),
    )


def recent_flagged(sample: DataFrame, features: DataFrame, newest: int = 50) -> DataFrame:
    """The newest flagged rows of a scored sample, with the rules of their features; rows without features have none."""
    rules = rule_flags(features).select("transaction_id", "rule_velocity", "rule_geo", "rule_amount")
    top = sample.where("combined_flag").orderBy(F.col("event_time").desc(), "transaction_id").limit(newest)
    return top.join(rules, "transaction_id", "left").orderBy(F.col("event_time").desc(), "transaction_id")


def promotion(flags: DataFrame, strategy: str = "combined_flag") -> DataFrame:
    """One row: a strategy's precision, its recall of each fraud type that has a floor, and whether it is promoted: each rate
    must be there and reach its floor. One aggregation."""
    hit, fraud = F.col(strategy), F.col("is_fraud") == 1
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rate = lambda c, of: one(c & of) / F.nullif(one(of), F.lit(0))
    rates = {"overall_precision": rate(fraud, hit)} | {f"recall_{t}": rate(hit, fraud & (F.col("fraud_type") == t)) for t in FLOOR_RECALL}
    row = flags.agg(*[c.alias(name) for name, c in rates.items()])
    good = F.col("overall_precision") >= FLOOR_PRECISION
    for t, least in FLOOR_RECALL.items():
        good = good & (F.col(f"recall_{t}") >= least)
    return row.select(F.lit(strategy).alias("strategy"), *rates, F.coalesce(good, F.lit(False)).alias("promoted"))
