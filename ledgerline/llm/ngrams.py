"""Hashed character n-gram counts: by label over all training rows, summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, ORDERS = 1 << 14, (1, 2, 3)


def counts(text: str | None) -> np.ndarray:
    """How often each hash bucket's n-grams occur in the lower-cased text."""
    out = np.zeros(SIZE, np.int64)
    whole = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
    x = np.frombuffer(whole, np.uint32).astype(np.uint64)
    for n in ORDERS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h * np.uint64(0x9E3779B1) + x[i : i + len(h)]) & np.uint64(0xFFFFFFFF)
                h ^= h >> np.uint64(15)
            out += np.bincount((h % np.uint64(SIZE)).astype(np.int64), minlength=SIZE)
    return out


def label_counts(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The labels, sorted, and their n-gram counts (labels x SIZE) over all rows (text, label).
    Each task gives out at most labels x SIZE sums, and so does the whole; labels are few."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                found[label] = found.get(label, 0) + counts(text)
        for label, c in found.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"label": label, "b": at, "n": c[at]})

    sums = rows.select("text", F.col("label").cast("string").alias("label")).mapInPandas(count, "label string, b int, n long").groupBy("label", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    labels = sorted(set(sums["label"]))
    out = np.zeros((len(labels), SIZE))
    for i, label in enumerate(labels):
        own = sums[sums["label"] == label]
        out[i, own["b"].to_numpy()] = own["n"].to_numpy()
    return labels, out
