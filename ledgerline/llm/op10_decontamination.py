"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that occurs in a document with at most e edits shares at least
m - q + 1 - q*e of its character q-grams with the document, within a band of diagonals (document
position minus item position) that is e wide on either side. e is RATE * m, or less where
the bound would be under one q-gram. For each document the shared q-grams are counted in overlapping
diagonal bands of width 4e, one starting each 2e, so that any such occurrence lies within one
band; a band that meets the bound is kept, and an alignment confined to its diagonals and e
more on either side verifies it.

Both texts are lower-cased, and each run of white space becomes one space. Items of fewer than q
characters are looked up as they are, without edits, and only as whole words: an end that is a
character of a word must not go on in the text (`yes` is not in `eyes`), but for scripts that put no
spaces between words. The benchmark is cut into blocks of at
most BLOCK_CHARS characters (or one longer item); each block is broadcast on its own and held
against all documents. Shared q-grams are counted at most PAIRS at a time, so very long and
repetitive texts take time, not memory.

Nulls: a null text is an empty one, and an empty item matches nothing; a null item_id counts as a
match like any other, but is not listed; a null doc_id is kept. Repeated documents are each
judged; repeated items are each listed, sorted, an id once. Empty tables give no matches. Extra
columns of the documents stay, except `items` and `contaminated`, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, scratch, session, staged, table

Q, RATE, BLOCK_CHARS, PAIRS = 8, 0.08, 1_000_000, 1 << 21
SPACE = re.compile(r"\s+")
#: Characters of words in scripts that divide words by spaces (without Thai to Myanmar, Khmer, kana, ideographs, Hangul).
SPACED = r"[^\W\u0e00-\u0eff\u1000-\u109f\u1100-\u11ff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"


def normal(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").lower()).strip()


def grams(text: str, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q-gram at each position."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edits_within(item: str, text: str, low: int, high: int, most: int) -> int:
    """Least edits that turn the item into a substring of the text by an alignment whose diagonals
    (text position minus item position) stay from low to high; most + 1 if more. Outside the text
    stands a character that equals none, so that using it costs as much as leaving one out."""
    m, wide = len(item), high - low + 1
    around = np.full(m + wide, -1, np.int64)
    start, end = max(0, low), min(len(text), m + high)
    if start < end:
        around[start - low : end - low] = code_points(text[start:end])
    row, at = np.zeros(wide, np.int32), np.arange(wide, dtype=np.int32)
    for i, c in enumerate(code_points(item).astype(np.int64)):
        step = row + (around[i : i + wide] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - at) + at
        if row.min() > most:
            return most + 1
    return int(row.min())


def whole_word(item: str) -> re.Pattern:
    """The item where neither end goes on as the same word."""
    before, after = (bool(re.match(SPACED, c)) for c in (item[:1], item[-1:]))
    return re.compile((f"(?<!{SPACED})" if before else "") + re.escape(item) + (f"(?!{SPACED})" if after else ""))


class Index:
    """The q-grams of a block of items, sorted for binary search."""

    def __init__(self, items: list[str], q: int = Q, rate: float = RATE):
        self.items, self.q = items, q
        self.edits = np.array([max(0, min(int(rate * len(t)), (len(t) - q) // q)) for t in items], np.int64)
        self.need = np.array([len(t) - q + 1 - q * e for t, e in zip(items, self.edits)], np.int64)
        found = [grams(t, q) for t in items]
        self.short = {i: whole_word(items[i]) for i, g in enumerate(found) if not len(g) and items[i]}
        codes = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.concatenate([*[np.full(len(g), i, np.int64) for i, g in enumerate(found)], np.zeros(0, np.int64)])
        at = np.concatenate([*[np.arange(len(g), dtype=np.int64) for g in found], np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes, self.item, self.at = codes[order], item[order], at[order]
        # Fewer shared q-grams than any item needs are none.
        self.least = max(1, min((int(n) for n, g in zip(self.need, found) if len(g)), default=1))
        self.unique, self.first = np.unique(self.codes, return_index=True)
        self.last = np.append(self.first[1:], len(self.codes))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shared q-grams, and which q-grams they are."""
        if not len(self.unique) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.unique, h)
        k[k == len(self.unique)] = 0
        pos = np.flatnonzero(self.unique[k] == h)
        return pos, k[pos]

    def hits(self, pos: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item and diagonal of each shared q-gram, about PAIRS at a time."""
        n = self.last[k] - self.first[k]
        part = (np.cumsum(n) - n) // PAIRS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(pos)]):
            c, first = n[start:end], self.first[k[start:end]]
            which = np.repeat(first - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
            yield self.item[which], np.repeat(pos[start:end], c) - self.at[which]

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest) of the bands that meet the bound."""
        pos, k = self.lookup(grams(text, self.q))
        if len(pos) < self.least:
            return []
        few = (self.last[k] - self.first[k]).sum() <= PAIRS
        held = list(self.hits(pos, k)) if few else None
        shared = sum(np.bincount(item, minlength=len(self.items)) for item, _ in held or self.hits(pos, k))
        enough = (shared >= self.need) & (shared > 0)
        if not enough.any():
            return []
        base, zero = 1 << 40, 1 << 20
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, diagonal in held or self.hits(pos, k):
            keep = enough[item]
            item, diagonal = item[keep], diagonal[keep]
            band = np.floor_divide(diagonal, np.maximum(1, 2 * self.edits[item])) + zero
            key, count = np.unique(np.concatenate([item * base + band, item * base + band - 1]), return_counts=True)
            if len(keys):
                keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, count]), len(keys)).astype(np.int64)
            else:
                keys, counts = key, count
        i, b = keys // base, keys % base - zero
        good = counts >= self.need[i]
        out = []
        for i, b in zip(i[good].tolist(), b[good].tolist()):
            e = int(self.edits[i])
            step = max(1, 2 * e)
            out.append((i, b * step - e, (b + 2) * step - 1 + e))
        return out

    def matches(self, raw: str | None) -> list[int]:
        text, found = normal(raw), set()
        if not text:
            return []
        for i, low, high in self.regions(text):
            if i not in found:
                item, most = self.items[i], int(self.edits[i])
                if item in text[max(0, low) : max(0, high + len(item))] or (most and edits_within(item, text, low, high, most) <= most):
                    found.add(i)
        found.update(i for i, word in self.short.items() if self.items[i] in text and word.search(text))
        return sorted(found)


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[dict[str, list]]:
    """The items, block by block, of at most `most` characters or one item: text -> item_ids."""
    block, size = {}, 0
    rows = benchmark.select("item_id", "text").where("length(trim(coalesce(text, ''))) > 0").orderBy("item_id")
    for item_id, text in rows.toLocalIterator():
        text = normal(text)
        if block and size + len(text) > most:
            yield block
            block, size = {}, 0
        size += len(text) if text not in block else 0
        block.setdefault(text, []).append(item_id)
    if block:
        yield block


def finder(shared):
    """UDF from text to (contaminated, items): whether any item of the block occurs in it, and which."""

    @F.pandas_udf("struct<contaminated boolean, items array<long>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        ids, index = shared.value
        hits = [index.matches(t) for t in texts]
        return pd.DataFrame({"contaminated": [bool(h) for h in hits], "items": [sorted({x for i in h for x in ids[i] if x is not None}) for h in hits]})

    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with contaminated, and items: the sorted item_ids that occur in each document."""
    spark = session(docs)
    docs = docs.drop("contaminated", "items")
    none = {"contaminated": F.lit(False), "items": F.array().cast("array<long>")}
    held, x = [], free_name(docs)
    for block in blocks(benchmark, block_chars):
        held.append((list(block.values()), Index(list(block), q, rate)))
        if len(held) == 2:
            break
    if not held:
        return docs.withColumns(none)
    if len(held) == 1:
        return docs.withColumn(x, finder(spark.sparkContext.broadcast(held[0]))("text")).select("*", f"{x}.*").drop(x)
    # Several blocks: one is in memory at a time, and gives out the numbers of the rows it hits.
    row = free_name(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    with scratch(spark) as write:
        hits = None
        for block in blocks(benchmark, block_chars):
            shared = spark.sparkContext.broadcast((list(block.values()), Index(list(block), q, rate)))
            some = write(numbered.select(row, finder(shared)("text").alias(x)).where(f"{x}.contaminated").select(row, f"{x}.items"))
            hits = some if hits is None else hits.unionByName(some)
            shared.destroy()
        hits = staged(hits.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "decontamination-hits")
    out = numbered.join(hits, row, "left")
    return out.withColumns({"contaminated": F.col("items").isNotNull(), "items": F.coalesce("items", none["items"])}).select(*docs.columns, "contaminated", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark item, with the columns they had."""
    flag = contaminated(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), benchmark)
    return flag.where("not contaminated").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and items of the contaminated documents."""
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.where("contaminated").select("doc_id", "items")
