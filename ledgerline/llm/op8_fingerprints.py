"""Document fingerprints by consistent weighted sampling.

A text is the bag of its lower-cased words, each weighted by its count. For each of SAMPLES
samples a word draws r and c from Gamma(2, 1) and b uniformly, all functions of the word
alone; with t = floor(ln w / r + b), the word of least ln c - r (t - b) - r is sampled, and
(word, t) is kept as 16 bits. Two fingerprints agree in a sample with the probability that is
the generalised Jaccard similarity of their bags, sum of minima over sum of maxima.

Documents are dealt by ranges of doc_id, bounded by approximate quantiles, and streamed in
order within a range; the first document of each range also goes to the range before, so that
each document meets its successor by one shuffle of the texts.

Nulls: a null text is an empty one; an empty bag has a fingerprint of its own, alike only to
itself. Null doc_ids come first; equal ids are ordered by their text's hash. The last document's
successor is the first. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, table

SAMPLES, KEPT, DRAWN = 128, 65_536, 64
WORD = re.compile(r"\w+")


#: For str.translate, which is fast for ASCII: characters of no word become spaces.
BLANKS = {c: " " for c in range(128) if not WORD.match(chr(c))}


def words_of(text: str) -> list[str]:
    """What WORD finds in the lower-cased text."""
    text = text.lower()
    return text.translate(BLANKS).split() if text.isascii() else WORD.findall(text)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Sampler:
    """Signatures of bags; keeps the draws of up to KEPT words. When full it keeps those of the half that stood in most texts."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.ids = samples, {}
        self.r = np.zeros((KEPT, samples), np.float32)
        self.b = np.zeros((KEPT, samples), np.float32)
        self.once = np.zeros((KEPT, samples), np.float32)
        self.code = np.zeros(KEPT, np.uint64)
        self.hits = np.zeros(KEPT, np.int64)

    def forget(self) -> None:
        n = len(self.ids)
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[: KEPT // 2])
        words = list(self.ids)
        self.ids = {words[i]: k for k, i in enumerate(keep.tolist())}
        for kept in (self.r, self.b, self.once, self.code):
            kept[: len(keep)] = kept[keep]
        self.hits[: len(keep)] = self.hits[keep] // 2
        self.hits[len(keep) :] = 0

    def draw(self, words: list[str]) -> None:
        at = np.arange(len(self.ids), len(self.ids) + len(words))
        self.ids.update(zip(words, at.tolist()))
        seed = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        self.code[at] = seed
        start = mixed(seed)
        k = np.arange(-(-self.samples * 5 // 2), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for i in range(0, len(words), DRAWN):
            # Two uniforms of 24 bits from each hash, for a few words at once, which stay in cache.
            u = mixed(start[i : i + DRAWN, None] + k).view(np.uint32)[:, : self.samples * 5] >> np.uint32(8)
            u = u.astype(np.float32)
            u += np.float32(0.5)
            u *= np.float32(2.0**-24)
            u = u.reshape(len(u), 5, self.samples)
            r, b, to = -np.log(u[:, 0] * u[:, 1]), u[:, 4], slice(at[i], at[i] + len(u))
            self.r[to], self.b[to] = r, b
            self.once[to] = np.log(-np.log(u[:, 2] * u[:, 3])) + r * b - r

    def places(self, words: list[str]) -> np.ndarray:
        """Where the draws of the words stand, KEPT // 2 words at most."""
        look = lambda: np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        at = look()
        fresh = np.flatnonzero(at < 0)
        if len(self.ids) + len(fresh) > KEPT:
            self.forget()
            at = look()
            fresh = np.flatnonzero(at < 0)
        if len(fresh):
            n = len(self.ids)
            self.draw([words[i] for i in fresh.tolist()])
            at[fresh] = np.arange(n, n + len(fresh))
        self.hits[at] += 1
        return at

    def signature(self, text: str) -> np.ndarray:
        bag = Counter(words_of(text))
        if not bag:
            return np.zeros(self.samples, np.uint16)
        found = self.sampled(bag, False) if len(bag) <= KEPT // 2 else None
        best, key = self.sampled(bag, True) if found is None else found
        return (key % np.uint64(65535)).astype(np.uint16) + np.uint16(1)

    def sampled(self, bag: dict[str, int], ordered: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Of each sample the least value and the key of its word. Of equal values that of the first word in order
        counts, so that equal bags are alike; without the order there is no result if values are equal."""
        best, key, k = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.arange(self.samples)
        words = sorted(bag) if ordered else list(bag)
        for part in (words[i : i + KEPT // 2] for i in range(0, len(words), KEPT // 2)):
            at, n = self.places(part), np.fromiter(map(bag.__getitem__, part) if ordered else bag.values(), np.float32, len(part))
            a, many = self.once.take(at, 0), np.flatnonzero(n > 1)
            # The last row is for words that stand once.
            t, row = np.zeros((len(many) + 1, self.samples), np.float32), np.full(len(at), len(many))
            if len(many):
                m = at[many]
                r = self.r.take(m, 0)
                t[:-1] = np.floor(np.log(n[many])[:, None] / r + self.b.take(m, 0))
                a[many] -= r * t[:-1]
                row[many] = np.arange(len(many))
            low = a.argmin(0)
            least = a[low, k]
            if not ordered and np.count_nonzero(a == least) > self.samples:
                return None
            better = least < best
            code = mixed(self.code[at[low]] + t[row[low], k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            best, key = np.where(better, least, best), np.where(better, code, key)
        return best, key


@lru_cache(maxsize=1)
def sampler_of(samples: int) -> Sampler:
    """The sampler of this process, so that a worker's later tasks find the draws of its earlier ones."""
    return Sampler(samples)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, part, h, lent): each row in its range, and the first of a range also in the
    range before it (lent), sorted within partitions; the first of all is also lent to the last."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    edges = np.array(sorted(set(edges)), np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(edges, ids.fillna(0).to_numpy().astype(np.int64), side="right")
        return pd.Series(np.where(known, at, 0).astype(np.int32))

    # Null ids, whose floats would lose digits in pandas, are told apart ahead of the function.
    rows = docs.select("doc_id", "text", part(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("part"), F.xxhash64("text").alias("h"))
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("o")
    # One row for each range, so at most `ranges` of them: a proven bound for the broadcast.
    firsts = rows.groupBy("part").agg(first).select("part", "o.doc_id", "o.h").orderBy("part").collect()
    lend = spark.createDataFrame([(r["doc_id"], r["h"], r["part"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)], "f_id long, f_h long, f_part int, to int")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")) & (F.col("part") == F.col("f_part"))
    lent = rows.join(F.broadcast(lend), same, "left")
    own, other = F.struct("part", F.lit(False).alias("lent")), F.struct(F.col("to").alias("part"), F.lit(True).alias("lent"))
    both = lent.withColumn("x", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, other))))
    both = both.select("doc_id", "text", "h", "x.part", "x.lent")
    return both.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "lent", F.col("doc_id").asc_nulls_first(), "h")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    session(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, held = sampler_of(samples), None
        for batch in batches:
            out = []
            for doc_id, text, part, lent in zip(batch["doc_id"], batch["text"], batch["part"], batch["lent"]):
                text = text if isinstance(text, str) else ""
                now = (doc_id, text, None if lent else sampler.signature(text), part)
                if held is not None and held[3] == part:
                    mark = sampler.signature(text) if now[2] is None else now[2]
                    n = len(held[1])
                    edited = held[1][: n - n // 2] + text[: n // 2]
                    other = sampler.signature(edited)
                    out.append((None if pd.isna(held[0]) else int(held[0]), n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), held[2].astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(held[2], other), likeness(held[2], mark)))
                    held = None
                if not lent:
                    held = now
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return with_next(docs.select("doc_id", "text")).select("doc_id", "text", "part", "lent").mapInPandas(walk, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
