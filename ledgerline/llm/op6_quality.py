"""Quality by hierarchical empirical Bayes.

A document classifier (n-gram naive Bayes evidence and shape features under a logistic model)
gives each document a probability. Hosts and paths within hosts get Beta posteriors of these
probabilities: a path shrinks toward its host, a host toward the global mean, by prior
strengths estimated by moments from grouped sums. The score adds the path's posterior
log-odds, relative to the global ones, to the document's.

The classifier learns from at most CAP labelled documents of each class, chosen by a hash of
their ids from the labels alone, so that no text is shuffled for it; the sums cover all.
The host is `source`; the path within it is `lang`, for want of a URL. Nulls: null hosts and
paths are groups of their own; a null text is an empty one; null labels and ids of labels are
ignored; a doc_id labelled twice is good if all its labels are. Without labels of both classes
all evidence is 0.5. A score of exactly 0.5 is predicted 1. Whole texts count, however long.
Repeated rows are kept, an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rates, crc_mod, free_name, hash_fraction, scratch, session, staged, table
from .knmodel import logistic
from .ngrams import counts, label_counts

CAP, SEED, PULL = 5000, 23, 0.5


def shape(text: str, weights: np.ndarray) -> list[float]:
    c = counts(text)
    at = np.flatnonzero(c)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, k = max(1, len(text)), max(1, len(words))
    odd = sum(1 for x in text if not x.isalnum() and not x.isspace())
    return [float(c[at] @ weights[at] / c.sum()), odd / n, len(set(words)) / k, n / k, float(np.log1p(len(words))), 1 - len(set(lines)) / max(1, len(lines)), sum(map(str.isupper, text)) / n]


def labelled(docs: DataFrame, labels: DataFrame, cap: int = CAP) -> DataFrame:
    """text, quality and weight (how many labelled ids a row stands for) of about `cap` labelled
    ids of each class outside the held-out fold. An id that several documents have gives one, that
    with the least hash of its text, so that the rows are bounded as the ids are."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = bounded_rates(marks, "quality", cap)
    picks = marks.where(hash_fraction(SEED, F.col("doc_id")) < rate).select("doc_id", "quality", F.try_divide(F.lit(1.0), rate).alias("weight"))
    # About `cap` ids of each of two classes: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "quality", "weight"), F.xxhash64("text")).alias("row"))
    return one.select("row.*")


def train(rows: DataFrame):
    """The document classifier from rows (text, quality, weight); None without both classes."""
    session(rows)
    with scratch(rows.sparkSession) as staged:
        rows = staged(rows)
        labels, c = label_counts(rows.select("text", F.col("quality").alias("label")))
        if len(labels) < 2:
            return None
        share = (c + 1) / (c + 1).sum(1, keepdims=True)
        weights = np.log(share[1]) - np.log(share[0])
        fit = features(rows, weights, "x").select("quality", "weight", "x").toPandas()
    y, w = fit["quality"].to_numpy(np.float64), fit["weight"].to_numpy(np.float64)
    mean, scale, b = logistic(np.array(fit["x"].tolist()), y, w / w.mean())
    return weights, b[:-1] / scale, float(b[-1] - (mean * b[:-1] / scale).sum())


def features(docs: DataFrame, weights: np.ndarray, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def x(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shape(t or "", shared.value))

    return docs.withColumn(name, x("text"))


def evidence(docs: DataFrame, model) -> DataFrame:
    """docs with the document classifier's probability."""
    session(docs)
    if model is None:
        return docs.withColumn("evidence", F.lit(0.5))
    weights, slopes, bias = model
    logit, x = F.lit(bias), free_name(docs)
    for i, slope in enumerate(slopes):
        logit = logit + F.col(x)[i] * float(slope)
    return features(docs, weights, x).withColumn("evidence", 1 / (1 + F.exp(-logit))).drop(x)


def log_odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame) -> float:
    """Prior strength by moments from groups (n, m, mu): how many documents the parent's mean
    is worth; from 1 to 10,000."""
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("mu")) ** 2).alias("ss"), F.sum(F.col("mu") * (1 - F.col("mu")) * F.col("n")).alias("v"), F.count("*").alias("k")).first()
    if not row["k"]:
        return 1.0
    within = row["v"] / row["n"]
    between = max(row["ss"] / row["n"] - within * row["k"] / row["n"], 1e-9)
    return float(min(10_000.0, max(1.0, within / between - 1)))


def score(docs: DataFrame, model, host: str = "source", path: str = "lang", pull: float = PULL) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, predicted (score >= 0.5)."""
    slim = staged(evidence(docs.select("doc_id", "text", F.col(host).alias("h"), F.col(path).alias("p")), model).drop("text"), "quality")
    mu = slim.agg(F.avg("evidence")).first()[0] or 0.5
    paths = staged(slim.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "quality-paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumns({"m": F.col("s") / F.col("n"), "mu": F.lit(mu)})
    a = strength(hosts)
    hosts = hosts.select(F.col("h").alias("hh"), ((F.col("s") + a * mu) / (F.col("n") + a)).alias("host_posterior"))
    near = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).drop("hh").withColumns({"m": F.col("s") / F.col("n"), "mu": F.col("host_posterior")})
    near = staged(near, "quality-near")
    b = strength(near)
    near = staged(near.select(F.col("h").alias("hh"), F.col("p").alias("pp"), "host_posterior", ((F.col("s") + b * F.col("mu")) / (F.col("n") + b)).alias("path_posterior")), "quality-posteriors")
    out = slim.join(near, F.col("h").eqNullSafe(F.col("hh")) & F.col("p").eqNullSafe(F.col("pp")))
    logit = log_odds(F.col("evidence")) + pull * (log_odds(F.col("path_posterior")) - log_odds(F.lit(mu)))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)
