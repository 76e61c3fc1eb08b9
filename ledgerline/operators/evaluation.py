"""Anomaly model over card features: split, imputation, isolation forest, scores, threshold sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.reports import confusion_of
from .quantiles import exact_quantiles
from .velocity import rule_flags

#: The features in the order the model reads them.
NUMERIC = ("amount", "txn_count_1h", "txn_count_24h", "amount_sum_24h", "amount_avg_24h", "amount_vs_avg_24h_ratio", "minutes_since_last_txn", "distinct_countries_24h", "implied_speed_kmh")
BOOLEAN = ("is_card_present", "is_online", "is_high_risk_mcc", "was_declined", "has_history")
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.10)
TREES, SAMPLE, CONTAMINATION, SEED = 200, 256, 0.02, 42


def split(df: DataFrame, ratio: float = 0.75, key: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """df with `split`: train for `ratio` of the keys by hash, else test; needs no shuffle, and
    within each label the shares differ from the ratio only by chance."""
    part = F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(part < int(ratio * 2**32), "train").otherwise("test"))


def rate_by_split(df: DataFrame) -> DataFrame:
    per = df.groupBy("split", "is_fraud").agg(F.count("*").alias("n"))
    total = per.groupBy("split").agg(F.sum("n").alias("total"))
    return per.join(total, "split").select("split", "is_fraud", "n", (F.col("n") / F.col("total")).alias("share"))


def medians(train: DataFrame) -> DataFrame:
    """One row: what stands in for missing recency and missing averages."""
    return train.agg(F.median("minutes_since_last_txn").alias("minutes_since_last_txn"), F.median("amount_avg_24h").alias("amount_avg_24h"))


def impute(df: DataFrame, fill: DataFrame) -> DataFrame:
    """df with numeric features as doubles without nulls: medians, ratio 1, speed 0, sum 0."""
    fill = fill.select([F.col(c).alias(f"fill_{c}") for c in fill.columns])
    other = {"amount_vs_avg_24h_ratio": F.lit(1.0), "implied_speed_kmh": F.lit(0.0), "amount_sum_24h": F.lit(0.0)} | {c: F.col(f"fill_{c}") for c in ("minutes_since_last_txn", "amount_avg_24h")}
    filled = {c: F.coalesce(F.col(c).cast("double"), other.get(c, F.lit(None).cast("double"))) for c in NUMERIC}
    return df.crossJoin(F.broadcast(fill)).withColumns(filled).drop(*fill.columns)


def vector(df: DataFrame) -> Column:
    """The features as one array in the declared order; a missing column is an error."""
    missing = [c for c in (*NUMERIC, *BOOLEAN) if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return F.array(*[F.col(c).cast("double") for c in NUMERIC], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in BOOLEAN])


def path_constant(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    many = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


def fit(train: DataFrame, trees: int = TREES, sample: int = SAMPLE, key: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """Nodes (tree, node, feature, cut, left, right, length) of an isolation forest. A hash of the key
    and the tree picks about `sample` rows for each tree, the bound on what one task gathers."""
    n = max(1, train.count())
    # Of all pairs of a row and a tree few are left, and only those carry the features.
    every = train.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    picked = F.pmod(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
    rows = every.where(picked).select(vector(train).alias("x"), "tree")
    deep = int(np.ceil(np.log2(max(2, min(sample, n)))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree, out = int(part["tree"].iloc[0]), []
        rng = np.random.default_rng([seed, tree])
        stack = [(np.array(sorted(map(tuple, part["x"]))), 0, None, False)]
        while stack:
            x, depth, parent, right = stack.pop()
            here = len(out)
            if parent is not None:
                out[parent][5 if right else 4] = here
            low, high = x.min(0), x.max(0)
            free = np.flatnonzero(high > low)
            if depth >= deep or not len(free):
                out.append([tree, here, -1, 0.0, -1, -1, float(depth + path_constant(len(x)))])
                continue
            f = int(rng.choice(free))
            cut = float(rng.uniform(low[f], high[f]))
            # Rounding between neighbouring floats must not leave one side empty.
            cut = cut if cut < high[f] else float(low[f])
            out.append([tree, here, f, cut, -1, -1, 0.0])
            stack += [(x[x[:, f] > cut], depth + 1, here, True), (x[x[:, f] <= cut], depth + 1, here, False)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "left", "right", "length"])

    return rows.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, length double")


def complete(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The tree with all leaves at its greatest depth, the children of place i at 2i + 1 and 2i + 2, so that rows walk
    down without tests: features and cuts of the inner places, lengths of the leaves, and the depth."""
    level, depth, levels = np.zeros(1, np.int64), 0, []
    while (feature[level] >= 0).any():
        inner = feature[level] >= 0
        levels.append((np.where(inner, feature[level], 0), np.where(inner, cut[level], 0.0)))
        # Below a leaf stand copies of it, whichever side a row takes.
        level = np.stack([np.where(inner, left[level], level), np.where(inner, right[level], level)], 1).ravel()
        depth += 1
    empty = (np.zeros(0, np.int64), np.zeros(0))
    features, cuts = (np.concatenate(parts) for parts in zip(empty, *levels))
    return features, cuts, length[level], depth


def score(df: DataFrame, nodes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """df with anomaly_score, from 0 to 1, higher: more anomalous. The forest has at most trees x 4 x
    sample nodes, which bounds what is broadcast."""
    held = nodes.orderBy("tree", "node").toPandas()
    forest = [complete(*(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "length"))) for _, t in held.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(batch.tolist(), np.float64).reshape(len(batch), -1)
            total, row, values = np.zeros(len(x)), np.arange(len(x)) * (x.shape[1] if len(x) else 1), x.ravel()
            for feature, cut, length, deep in shared.value:
                at = np.zeros(len(x), np.int64)
                for _ in range(deep):
                    right = ~(values.take(row + feature.take(at)) <= cut.take(at))
                    at *= 2
                    at += 1
                    at += right
                total += length.take(at - (2**deep - 1))
            yield pd.Series(2.0 ** (-total / max(1, len(shared.value)) / path_constant(np.array([sample]))[0]))

    return df.withColumn("anomaly_score", anomaly(vector(df)))


def cutoff(scored: DataFrame, contamination: float = CONTAMINATION) -> float:
    """The exact quantile of the scores that the most anomalous `contamination` of rows reach; 1 without rows. Pass a stored frame."""
    return or_one(exact_quantiles(scored, "anomaly_score", (1 - contamination,)))[0]


def or_one(cuts: list[float | None]) -> list[float]:
    return [1.0 if c is None else c for c in cuts]


def flag(scored: DataFrame, cut: float) -> DataFrame:
    """scored with model_flag, the rule flags and combined_flag."""
    out = rule_flags(scored.withColumn("model_flag", F.col("anomaly_score") >= cut))
    return out.withColumn("combined_flag", F.col("model_flag") | F.col("any_rule"))


def sweep(scored: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Confusion counts and rates for the exact cuts that flag each share of the rows. Pass a stored frame."""
    cuts = or_one(exact_quantiles(scored, "anomaly_score", tuple(1 - s for s in shares)))
    flags = {f"share_{round(s * 1000)}_per_mille": F.col("anomaly_score") >= c for s, c in zip(shares, cuts)}
    return confusion_of(scored.withColumns(flags), list(flags))


def recall_long(flags: DataFrame) -> DataFrame:
    """(fraud_type, strategy, recall) of the fraud rows."""
    names = ["rule_velocity", "rule_geo", "rule_amount", "any_rule"]
    wide = flags.where("is_fraud = 1").groupBy("fraud_type").agg(*[F.avg(F.col(n).cast("int")).alias(n) for n in names])
    return wide.unpivot(["fraud_type"], names, "strategy", "recall")
