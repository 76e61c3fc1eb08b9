"""Near copies by exact Jaccard similarity of word shingles, for the corpus pipeline.

A SimHash radius alone loses pairs: at a Jaccard similarity of 0.8 two fingerprints differ in 9.7
of 64 bits on average, and no radius holds them all. So op5's fingerprints and BK-trees give the
first candidates, which the exact similarity verifies, and what lies beyond their radius is
found by a prefix filter, so that no pair is lost. Let all shingles have one fixed order. Of two sets of similarity LEAST at least, the first n - ceil(LEAST n) + 1
shingles of each (n: its size) share one, so texts are dealt by those alone. Candidates that
pass a bound on their overlap, by bitmaps of a few bits a shingle, are verified by the exact
similarity of the two whole sets; only their texts are fetched.

The order puts shingles that are frequent in a sample last. It decides how many candidates
there are, never which pairs are found. The sample is a fixed part of the texts, so that shingles
of as many texts are put last however many texts there are, and buckets do not grow with the
table until LISTED shingles are put last. Links go in two passes, since a large family of near
copies has too many pairs: first the fingerprints' links and each text of a bucket, or of a share
of a large one, with its neighbours and the least; then all pairs that are still in different components. Rows of a large
bucket meet only those of about their own size there, in tasks that each have two shares of it.

A null text is an empty one, and all texts without words are alike. Equal texts are one; texts
of fewer than WIDTH words are one shingle. Whole texts count, however long; a similarity of
exactly LEAST is a link. An empty table gives no rows; columns other than text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, maybe_among, row_key, scratch, session, text_or_empty
from .components import components
from .op5_simhash import fingerprint, links, shingle_hashes

WIDTH, LEAST, SAMPLE, RATE, FREQUENT, LISTED, SMALL, BUCKET, SHARE, SEED = 5, 0.8, 20_000, 0.25, 4, 2_000_000, 16, 1_000_000, 20_000, 17


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64)).view(np.int64)


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shingles of at least FREQUENT different texts of a sample (a share of RATE; SAMPLE texts at least), sorted, and
    how many; LISTED at most; and the sample's rate."""
    rate = min(1.0, max(RATE, SAMPLE / max(1, texts.count())))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"g": np.concatenate(found) if found else np.zeros(0, np.int64)})

    seen = texts.where(hash_fraction(SEED, F.col("h")) < rate).dropDuplicates(["h"]).select("text").mapInPandas(each, "g long").groupBy("g").count()
    top = seen.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "g").limit(LISTED).toArrow()
    g, n = top["g"].to_numpy(), top["count"].to_numpy()
    order = np.argsort(g)
    return g[order], n[order], rate


def first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches without texts that the task has had, so that copies do not reach a shuffle."""
    seen: set[int] = set()
    for batch in batches:
        batch = batch.drop_duplicates("h")
        batch = batch[[h not in seen for h in batch["h"]]]
        seen.update(batch["h"])
        yield batch


def fingerprint_pairs(texts: DataFrame, width: int, staged) -> DataFrame:
    """(a, b), a < b: texts that op5's SimHash links. Each text meets the least one of its fingerprint, and the
    least ones of two fingerprints meet where op5's BK-trees link those; all these pairs are candidates.
    One Python step drops copies and takes fingerprints: a task with two such steps has a worker for
    each, and these stay to take memory in later stages."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in first_seen(batches):
            yield pd.DataFrame({"h": batch["h"], "fp": batch["text"].map(lambda t: fingerprint(t, width)).astype("int64")})

    marks = staged(texts.mapInPandas(each, "h long, fp long").distinct(), "near-marks")
    least = staged(marks.groupBy("fp").agg(F.min("h").alias("least")), "near-fingerprints")
    same = marks.join(least, "fp").where("h > least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    name = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_h"))
    other = links(least.select("fp")).join(name("a"), "a").join(name("b"), "b")
    return same.unionByName(other.select(F.least("a_h", "b_h").alias("a"), F.greatest("a_h", "b_h").alias("b")))


def prefixes(texts: DataFrame, width: int, least: float, bucket: int) -> DataFrame:
    """(g, s, h, n, p): the first shingles g of each text h, the size of its set and g's place. A text without
    words has the one shingle 0, so that all of those meet. Texts of a shingle that more than
    about `bucket` texts have are dealt to shares s from 0 on, differently for each shingle; else s is -1."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, width))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, count, rate = shared.value
        for batch in first_seen(batches):
            out, shares, sizes, lengths = [], [], [], []
            for h, text in zip(batch["h"], batch["text"]):
                s = shingle_set(text, width)
                n = len(s)
                times = np.zeros(n, np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    times = np.where(common[at] == s, count[at], 0)
                    order = np.lexsort((s, times))
                    s, times = s[order], times[order]
                k = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
                out.append(s[:k] if n else np.zeros(1, np.int64))
                sizes.append(n)
                lengths.append(len(out[-1]))
                parts = np.ceil(times[:k] / rate / bucket) if n else np.ones(1)
                mixed = (out[-1].view(np.uint64) ^ np.uint64(h & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                shares.append(np.where(parts > 1, mixed % np.maximum(parts, 1).astype(np.uint64), -1).astype(np.int32))
            if out:
                yield pd.DataFrame({"g": np.concatenate(out), "s": np.concatenate(shares), "h": np.repeat(batch["h"].to_numpy(), lengths), "n": np.repeat(np.array(sizes, np.int32), lengths), "p": np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])})

    return texts.mapInPandas(each, "g long, s int, h long, n int, p int")


def buckets(rows: DataFrame, least: float) -> DataFrame:
    """The rows whose g another h has too, with the next h of the share and its least. Shares stream by: a
    task holds one batch and the last row before it, however large a share is."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, many = None, None, False
        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("g", "s", "h", "n", "p")]
            if not len(batch):
                continue
            if last is not None:
                columns = [np.append(x, y) for x, y in zip(last, columns)]
            g, s, h = columns[:3]
            unlike = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (h[1:] != h[:-1]))
            g, s, h, n, p = columns = [c[unlike] for c in columns]
            same = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            start = np.flatnonzero(np.append(True, ~same))
            at = np.repeat(start, np.diff(np.append(start, len(g))))
            h0, n0 = h[at], n[at]
            if first is not None:
                h0[at == 0], n0[at == 0] = first
            several = np.append(many, same)
            to = np.where(same, np.arange(1, len(g)), np.arange(len(g) - 1))
            yield linked([c[:-1] for c in columns], (h0[:-1], n0[:-1]), (h[to], n[to]), several[:-1] | same)
            last, first, many = [c[-1:] for c in columns], (h0[-1], n0[-1]), bool(several[-1])
        if last is not None:
            yield linked(last, tuple(np.array([v]) for v in first), (last[2], last[3]), np.array([many]))

    def linked(columns, first, following, several) -> pd.DataFrame:
        g, s, h, n, p = columns
        # A row whose neighbour or first is too long or too short points to itself.
        ends = [np.where(np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9, to, h) for to, m in (first, following)]
        return pd.DataFrame({"g": g, "h": h, "n": n, "p": p, "least": ends[0], "next": ends[1]})[several | (s >= 0)]

    return rows.repartition("g", "s").sortWithinPartitions("g", "s", "n", "h").mapInPandas(each, "g long, h long, n int, p int, least long, next long")


def may_be(n, p, m, q, least: float):
    """Whether sets of n and m shingles whose first common ones are p-th and q-th at the earliest can be
    similar: no more can be shared than follow in either."""
    both = least / (1 + least) * (n + m) - 1e-6
    return (n - p >= both) & (m - q >= both) | (n + m == 0)


def bitmaps(texts: DataFrame, width: int) -> DataFrame:
    """(h, n, k, bits, half): a set's size, and for each of 2^k > 2n buckets, 64 to a long, whether an
    odd number of its shingles fall in it; the same for half as many buckets."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in first_seen(batches):
            out = []
            for h, text in zip(batch["h"], batch["text"]):
                s = shingle_set(text, width).view(np.uint64)
                k = max(7, int(2 * len(s)).bit_length())
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & ((1 << k) - 1), minlength=1 << k) & 1
                bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
                out.append((h, len(s), k, bits, bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]))
            yield pd.DataFrame(out, columns=["h", "n", "k", "bits", "half"])

    return texts.mapInPandas(each, "h long, n int, k int, bits array<long>, half array<long>")


def overlap_enough(x: str, y: str, least: float) -> Column:
    """Whether sets with these bitmaps can share enough: a bucket that differs holds a shingle that is
    not shared. Similar sets have as many buckets or twice as many."""
    col = lambda side, name: F.col(f"{side}.{name}")
    a = F.when(col(x, "k") > col(y, "k"), col(x, "half")).otherwise(col(x, "bits"))
    b = F.when(col(y, "k") > col(x, "k"), col(y, "half")).otherwise(col(y, "bits"))
    differ = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    total = col(x, "n") + col(y, "n")
    return (F.abs(col(x, "k") - col(y, "k")) <= 1) & ((total - differ) / 2 >= least / (1 + least) * total - 1e-6)


def likely(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    both = pairs.join(bits.alias("x").hint("merge"), F.col("a") == F.col("x.h")).join(bits.alias("y").hint("merge"), F.col("b") == F.col("y.h"))
    return both.where(overlap_enough("x", "y", least)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, bits: DataFrame, width: int, least: float, staged) -> DataFrame:
    """The pairs (a, b) whose sets are similar by at least `least`."""
    pairs = staged(likely(pairs, bits, least), "near-likely")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    some = staged(maybe_among(texts, "h", ends).join(ends, "h", "left_semi").dropDuplicates(["h"]), "near-texts")
    both = pairs.join(some.select(F.col("h").alias("a"), F.col("text").alias("s")), "a").join(some.select(F.col("h").alias("b"), F.col("text").alias("t")), "b")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            hit = []
            for a, b, s, t in zip(batch["a"], batch["b"], batch["s"], batch["t"]):
                if len(known) > 256:
                    known.clear()
                for h, text in ((a, s), (b, t)):
                    if h not in known:
                        known[h] = shingle_set(text, width)
                x, y = known[a], known[b]
                same = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(same >= least * (len(x) + len(y) - same) - 1e-9)
            yield batch.loc[np.array(hit, bool), ["a", "b"]]

    return both.mapInPandas(each, "a long, b long")


def dealt(rows: DataFrame, least: float) -> DataFrame:
    """The rows, each in its band of sizes and the next one (similar sets are no more than a band apart) and, where
    the shingle has several shares (column parts), once with each of them as the pair (i, j) of shares."""
    own = F.floor(F.log(F.greatest("n", F.lit(1))) / (-math.log(least) * (1 + 1e-9))).cast("int")
    rows = rows.withColumns({"own": own, "part": F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")})
    rows = rows.select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


def meet_once() -> Column:
    """Whether rows x and y of `dealt` stand in the same bucket, band and shares, and in no others together."""
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("g", "band", "i", "j")]
    once = [F.greatest("x.own", "y.own") == F.col("x.band"), F.least("x.part", "y.part") == F.col("x.i"), F.greatest("x.part", "y.part") == F.col("x.j")]
    return reduce(Column.__and__, [*same, *once])


def similar(docs: DataFrame, width: int = WIDTH, least: float = LEAST, bucket: int = BUCKET, small: int = SMALL, share: int = SHARE) -> DataFrame:
    """(h, root): row_key of each distinct text that has a near copy, and its component (roots are left out)."""
    with scratch(session(docs)) as staged:
        texts = docs.select(row_key("text").alias("h"), text_or_empty().alias("text"))
        rows = staged(buckets(prefixes(texts, width, least, bucket), least), "near-buckets")
        bits = staged(bitmaps(maybe_among(texts, "h", rows.select("h")), width), "near-bitmaps").dropDuplicates(["h"])
        near = rows.select("h", F.explode(F.array("least", "next")).alias("o")).where("h <> o")
        near = near.select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b"))
        near = staged(near.unionByName(fingerprint_pairs(texts, width, staged)).distinct(), "near-pairs")
        found = staged(verified(near, texts, bits, width, least, staged), "near-links")
        roots = components(found)
        named = rows.join(roots, rows["h"] == roots["node"], "left").select("g", "h", "n", "p", F.coalesce("root", "h").alias("c"))
        split = named.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
        open_ = staged(named.join(split, "g", "left_semi"), "near-open")
        # Pairs of small buckets are few for each row; in others the bitmaps rule out pairs in the join itself.
        big = open_.groupBy("g").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"), F.count("*").alias("many")).where(F.col("many") > small).select("g", "parts")
        few = open_.join(big, "g", "left_anti")
        many = dealt(open_.join(big, "g"), least).join(bits.drop("n").hint("merge"), "h")
        rest = None
        for rows, enough in ((few, F.col("x.g") == F.col("y.g")), (many, meet_once() & overlap_enough("x", "y", least))):
            alike = may_be(F.col("x.n"), F.col("x.p"), F.col("y.n"), F.col("y.p"), least)
            pairs = rows.alias("x").join(rows.alias("y"), enough & (F.col("x.h") < F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & alike)
            pairs = pairs.select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
            rest = pairs if rest is None else rest.unionByName(pairs)
        rest = staged(rest.distinct().join(near, ["a", "b"], "left_anti"), "near-rest")
        more = verified(rest, texts, bits, width, least, staged)
        return components(found.unionByName(more)).select(F.col("node").alias("h"), "root")
