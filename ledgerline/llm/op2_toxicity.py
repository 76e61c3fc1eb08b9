"""Toxicity by class-conditional Kneser-Ney models.

Two pairs of models, toxic and ordinary, are counted over all labelled training rows, each
distinct text once:

* spelling: characters given the four before them, p_c(x|v) = max(n_c(vx) - D_c, 0) / n_c(v) +
  D_c t_c(v) / n_c(v) * q(x|v'). All shorter contexts are one interpolated Kneser-Ney model q of
  both classes, by counts of different left contexts: the shared backoff, in which rare
  expressions are alike for both classes unless their own counts say otherwise.
* words: p_c(w) = max(n_c(w) - D_c, 0) / n_c + D_c t_c / n_c * q(w), n: texts with the word,
  q(w) shared by both classes.

Counts, discounts and probabilities are tables in Spark that grow with the labelled rows. What
is broadcast is their log ratios by hash: 2^22 grams, as many contexts, and 2^23 words at
most, half-precision floats, compressed, 33 MB in all however much was counted. Grams or words
that share a slot share their mean ratio by count; no text and no expression is left out.

A document is scored by the length-normalised log-likelihood ratios of its whole text and what
its most toxic words add (knmodel.features), calibrated by a logistic on labelled rows, each by
models that were counted without its fold. Only that logistic is fitted on a bounded sample,
FIT texts of each class.

Nulls and ties: a null text is an empty one and gets the score of no evidence; null ids and
labels teach nothing; a doc_id labelled twice, or a text with several labels, is toxic if one
label is. Copies teach once. Without labels of both classes all scores are 0. Very long texts
are worked through in pieces. An empty table gives no rows. Repeated rows are kept, and all
columns stay except `score` and `predicted`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_rates, crc_mod, free_name, hash_fraction, maybe_among, scratch, session, table, text_or_empty
from .knmodel import GRAM_BITS, NAMES, ORDER, WORD_BITS, Pair, features, grams, logistic, packed, pieces, spelled, unpacked, words

FIT, THRESHOLD, SEED, FOLDS = 3000, 0.7, 11, 3
#: A model for each fold, counted without it, and the last counted from all.
MODELS = FOLDS + 1
CELLS = [f"n{c}_{f}" for c, f in product((0, 1), range(FOLDS))]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the distinct labelled texts outside the held-out part.

    Ids and hashes alone settle which rows teach; then only those texts are shuffled, once."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("doc_id is not null").where(crc_mod("doc_id", 3) != 1).select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    one = rows.select("doc_id", "h").join(marks.hint("merge"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    some = maybe_among(rows, "doc_id", marks.select("doc_id"))
    # Repeated rows of one id and text are one.
    return some.join(one.hint("merge"), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


def cell() -> Column:
    return (F.col("toxic") * FOLDS + F.col("fold")).alias("cell")


def by_cell(rows: DataFrame, key: str, *rest: str) -> DataFrame:
    """n{class}_{fold} for each key."""
    sums = [F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).cast("float").alias(name) for i, name in enumerate(CELLS)]
    return rows.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], *sums)


def counted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, code, context, n...) of the grams, and (code, n...) of the words, over all texts."""

    def groups(batch: pd.DataFrame) -> Iterator[tuple[int, list[np.ndarray]]]:
        for k, part in batch.groupby("cell"):
            yield int(k), [x for text in part["text"] for x in map(spelled, pieces(text)) if len(x)]

    def each_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, xs in groups(batch):
                if not xs:
                    continue
                found = [grams(x) for x in xs]
                code, at, n = np.unique(np.concatenate([c for c, _ in found]), return_index=True, return_counts=True)
                context = np.concatenate([v for _, v in found])[at]
                joined = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, ORDER) for x in xs])[at].astype("<u4")
                text = joined.tobytes().decode("utf-32-le", "replace")
                yield pd.DataFrame({"g": [text[i : i + ORDER] for i in range(0, len(text), ORDER)], "code": code.view(np.int64), "context": context.view(np.int64), "cell": np.int32(k), "n": n})

    def each_word(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("cell"):
                found = [np.unique(np.concatenate([words(spelled(p)) for p in pieces(text)] or [np.zeros(0, np.uint64)])) for text in part["text"]]
                code, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"code": code.view(np.int64), "cell": np.int32(k), "n": n})

    rows = texts.select("text", cell())
    g = by_cell(rows.mapInPandas(each_gram, "g string, code long, context long, cell int, n long"), "g", "code", "context")
    return g, by_cell(rows.mapInPandas(each_word, "code long, cell int, n long"), "code")


def count_of(c: int, m: int) -> Column:
    """Count of class c in model m, which leaves out fold m (the last leaves out none)."""
    return sum((F.col(f"n{c}_{f}") for f in range(FOLDS) if f != m), F.lit(0))


def discount(once: int | None, twice: int | None) -> float:
    once, twice = once or 0, twice or 0
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def statistics(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int, float]]:
    """(class, model) -> total, types and discount."""
    sums = []
    for c, m in product((0, 1), range(MODELS)):
        n = count_of(c, m)
        sums += [F.sum(n).alias(f"s{c}_{m}"), F.sum((n > 0).cast("long")).alias(f"t{c}_{m}"), F.sum((n == 1).cast("long")).alias(f"o{c}_{m}"), F.sum((n == 2).cast("long")).alias(f"w{c}_{m}")]
    r = rows.agg(*sums).first()
    return {(c, m): (r[f"s{c}_{m}"] or 0, r[f"t{c}_{m}"] or 0, discount(r[f"o{c}_{m}"], r[f"w{c}_{m}"])) for c, m in product((0, 1), range(MODELS))}


def backoff(rows: DataFrame, staged) -> DataFrame:
    """(s, q): the shared model's probability of the last character of s given those before it,
    s: the last ORDER - 1 characters of a gram. `rows` has each gram g once."""
    level, levels = rows.select(F.col("g").alias("s")), []
    for k in range(ORDER - 1, 0, -1):
        level = staged(level.groupBy(F.expr(f"right(s, {k})").alias("s")).agg(F.count("*").alias("n")))
        levels.append(level)
    total = levels[-1].agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    q = levels[-1].select("s", ((F.col("n") + 1) / ((total["n"] or 0) + total["v"] + 1)).alias("q"))
    for k, level in zip(range(2, ORDER), levels[-2::-1]):
        seen = level.agg(F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).first()
        d = discount(seen["once"], seen["twice"])
        same = Window.partitionBy(F.expr(f"left(s, {k - 1})"))
        own = level.select("s", "n", F.expr(f"right(s, {k - 1})").alias("short"), F.sum("n").over(same).alias("total"), F.count("*").over(same).alias("types"))
        q = own.join(q.select(F.col("s").alias("short"), F.col("q").alias("low")), "short").select("s", ((F.col("n") - d + d * F.col("types") * F.col("low")) / F.col("total")).alias("q"))
    return q


def ratios(rows: DataFrame, above: str, below: str, name: str) -> dict[str, Column]:
    return {f"{name}{m}": F.log(F.col(f"{above}_{m}") / F.col(f"{below}_{m}")).cast("float") for m in range(MODELS)}


def spelling(rows: DataFrame, staged) -> DataFrame:
    """rows of counted grams with p{class}_{model} and the backoff weights l{class}_{model} of their contexts."""
    known = statistics(rows)
    sums = []
    for c, m in product((0, 1), range(MODELS)):
        sums += [F.sum(count_of(c, m)).cast("float").alias(f"s{c}_{m}"), F.sum((count_of(c, m) > 0).cast("float")).cast("float").alias(f"t{c}_{m}")]
    contexts = rows.groupBy("context").agg(*sums)
    low = backoff(rows, staged).withColumnRenamed("s", "suffix")
    out = rows.withColumn("suffix", F.expr(f"right(g, {ORDER - 1})")).join(low, "suffix").drop("suffix").join(contexts, "context")
    more = {}
    for c, m in product((0, 1), range(MODELS)):
        d, total = known[c, m][2], F.col(f"s{c}_{m}")
        left = F.when(total > 0, d * F.col(f"t{c}_{m}") / total).otherwise(1.0)
        more[f"l{c}_{m}"] = left
        more[f"p{c}_{m}"] = F.when(total > 0, F.greatest(count_of(c, m) - d, F.lit(0.0)) / total).otherwise(0.0) + left * F.col("q")
    return out.withColumns(more)


def vocabulary(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """rows of counted words with p{class}_{model}, and the log ratio of a word not seen, by model."""
    known = statistics(rows)
    size = rows.count()
    total = sum(known[c, FOLDS][0] for c in (0, 1)) + size + 1
    share = {k: (d * t / s if s else 1.0) for k, (s, t, d) in known.items()}
    q = (count_of(0, FOLDS) + count_of(1, FOLDS) + 1) / total
    more = {}
    for c, m in product((0, 1), range(MODELS)):
        s, _, d = known[c, m]
        more[f"p{c}_{m}"] = F.greatest(count_of(c, m) - d, F.lit(0.0)) / max(1, s) + share[c, m] * q
    return rows.withColumns(more), [float(np.log(share[1, m] / share[0, m])) for m in range(MODELS)]


def slots(rows: DataFrame, code: str, bits: int, name: str) -> DataFrame:
    """(slot, r0, r1, ...): mean log ratio by count of what shares a slot, for each model; 2^bits rows at most.
    rows: the code, the count n and the ratios {name}{model}."""
    mean = [(F.sum(F.col("n") * F.col(f"{name}{m}")) / F.sum("n")).cast("float").alias(f"r{m}") for m in range(MODELS)]
    return rows.groupBy(F.shiftrightunsigned(code, 64 - bits).cast("int").alias("slot")).agg(*mean)


def array(rows: DataFrame, m: int, bits: int, rest: float) -> np.ndarray:
    """The ratios of model m by slot, half precision."""
    out = np.full(1 << bits, rest, np.float16)
    part = rows.select("slot", f"r{m}").toArrow()
    out[part["slot"].to_numpy()] = part[f"r{m}"].to_numpy()
    return out


def train(texts: DataFrame):
    """(Pair, calibration) from rows (text, toxic), or None without both classes."""
    session(texts)
    with scratch(texts.sparkSession) as staged:
        return fitted(staged(texts), staged)


def fitted(texts: DataFrame, staged):
    """`train` on written texts."""
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    h, rate = F.xxhash64("text"), bounded_rates(texts, "toxic", FIT)
    texts = texts.withColumns({"fold": F.floor(hash_fraction(SEED + 1, h) * FOLDS).cast("int"), "fit": hash_fraction(SEED, h) < rate})
    g, w = counted(texts)
    g, w = staged(g), staged(w)
    spell, (vocab, unseen) = spelling(g, staged), vocabulary(w)
    n = sum((F.col(x) for x in CELLS), F.lit(0)).cast("float").alias("n")
    spell = spell.withColumns(ratios(spell, "p1", "p0", "p") | ratios(spell, "l1", "l0", "l"))
    spell = staged(spell.select("code", "context", n, *[f"{x}{m}" for x in "pl" for m in range(MODELS)]))
    vocab = vocab.withColumns(ratios(vocab, "p1", "p0", "p")).select("code", n, *[f"p{m}" for m in range(MODELS)])
    tables = [staged(slots(spell, "code", GRAM_BITS, "p")), staged(slots(spell, "context", GRAM_BITS, "l")), staged(slots(vocab, "code", WORD_BITS, "p"))]

    def pair(m: int) -> Pair:
        return Pair(array(tables[0], m, GRAM_BITS, np.nan), array(tables[1], m, GRAM_BITS, 0.0), array(tables[2], m, WORD_BITS, np.nan), unseen[m])

    fits = []
    for f in range(FOLDS):
        shared = texts.sparkSession.sparkContext.broadcast(packed(pair(f)))
        fits.append(score_features(texts.where(F.col("fit") & (F.col("fold") == f)), shared).select("toxic", "x").toPandas())
        shared.destroy()
    fit = pd.concat(fits)
    if fit["toxic"].nunique() < 2:
        return None
    y = fit["toxic"].to_numpy(np.float64)
    # Classes weigh what they do among all labelled texts, not what the sample keeps of them.
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    weight /= weight.mean()
    return packed(pair(FOLDS)), logistic(np.array(fit["x"].tolist()), y, weight)


def score_features(rows: DataFrame, shared, name: str = "x") -> DataFrame:
    """rows with the features of their texts by the packed models that are broadcast. A task that has
    rows unpacks them once and lets them go at its end, since workers outlive their tasks."""

    @F.pandas_udf("array<double>")
    def x(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = None
        for texts in batches:
            pair = pair or unpacked(shared.value)
            yield texts.map(lambda t: features(t, pair))

    return rows.withColumn(name, x("text"))


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    session(docs)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    pair, (mean, scale, b) = model
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    weight = b[:-1] / scale
    logit, x = F.lit(float(b[-1] - (mean * weight).sum())), free_name(docs)
    for i in range(len(NAMES)):
        logit = logit + F.col(x)[i] * float(weight[i])
    out = score_features(docs, shared, x).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).drop(x)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
