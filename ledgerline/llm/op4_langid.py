"""Language ID by error-correcting output codes.

Each language has a codeword; for each of its bits, a binary naive Bayes classifier over
hashed character n-grams tells the languages with a one from those with a zero. The margins of
a text are decoded by loss weighting: the codeword of least total exponential loss wins, and
a text whose two best codewords are within TIE of each other is flagged as ambiguous.

All training rows count, whole; the model is languages x 2^14 sums. Nulls: a text that is
null or has no letter is `und` with score 0; a null lang trains nothing. Without training rows
all are `und`. Ties go to the language first in code point order. Repeated rows are kept and
extra columns stay.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, free_name, session, table
from .ngrams import counts, label_counts

TIE = 0.1


def codewords(n: int, length: int = 32) -> np.ndarray:
    """n rows of +1 and -1; each column has both. Up to 5 languages: each split of them in two, once.
    More: the random code, of some drawn with a fixed seed, whose nearest rows differ most."""
    if n <= 5:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(n)]).reshape(n, -1)
    rng, best = np.random.default_rng(7), None
    for _ in range(50):
        code = rng.choice([-1, 1], (n, length))
        same = np.flatnonzero(np.abs(code.sum(0)) == n)
        code[rng.integers(n, size=len(same)), same] *= -1
        near = min((code[i] != code[j]).sum() for i, j in combinations(range(n), 2))
        if best is None or near > best[0]:
            best = near, code
    return best[1]


def train(rows: DataFrame):
    """(languages, codewords, weights) from rows (text, lang); None without rows."""
    session(rows)
    langs, c = label_counts(rows.where("lang is not null").select("text", F.col("lang").alias("label")))
    if not langs:
        return None
    code = codewords(len(langs))
    share = c + 0.5
    share /= share.sum(1, keepdims=True)
    weights = np.stack([np.log(share[b == 1].mean(0)) - np.log(share[b == -1].mean(0)) for b in code.T], 1) if code.size else np.zeros((c.shape[1], 0))
    return langs, code, weights


def predict(docs: DataFrame, model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of those names are replaced."""
    session(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, ambiguous boolean>")
    def decoded(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if shared.value is None or not text or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, True))
                continue
            langs, code, weights = shared.value
            c = counts(text)
            at = np.flatnonzero(c)
            margin = c[at] @ weights[at] / c.sum()
            loss = np.exp(-np.clip(code * margin * 4, -30, 30)).sum(1)
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = int(np.argmax(p))
            rest = np.delete(p, best)
            out.append((langs[best], float(p[best]), bool(len(rest) and p[best] - rest.max() < TIE)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    x = free_name(docs)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    return docs.withColumn(x, decoded("text")).select(*kept, f"{x}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
