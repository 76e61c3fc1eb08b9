"""SimHash near-duplicates: 64-bit fingerprints, BK-trees, connected components.

Fingerprints are computed in Arrow batches. Equal ones are one node. Two fingerprints that
differ in 3 bits or fewer agree on at least one of four 16-bit blocks, so each distinct
fingerprint goes to four shards, by block and value; a shard of over SHARD fingerprints is
dealt again by four 12-bit parts of the other 48 bits, which loses no link either. Each
shard grows a BK-tree; a walk follows only edges within the radius, and a shard gives out a
spanning forest of its links, never all pairs.

Nulls: a null text is an empty text (fingerprint zero). A null doc_id is grouped like any
other, but is never the least id of its component unless all are null. Repeated rows are
kept. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, staged, table
from .components import components

RADIUS, SHARD, WORDS = 3, 2048, 3


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """Words are split at ASCII white space and A-Z lower-cased, as bytes do it. A text of
    fewer words is one shingle, one of none has no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), 42)] if words else []
    return [digest(b" ".join(s), 42) for s in zip(*[words[i:] for i in range(width)])]


def fingerprint(text: str | None, width: int = WORDS) -> int:
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """docs with fp, a long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, width)).astype("int64")

    session(docs)
    return docs.withColumn("fp", fp("text"))


class Tree:
    """BK-tree: children keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def near_and_add(self, x: int, radius: int) -> list[int]:
        """The nodes within the radius of x; x is added."""
        nodes, found = self.nodes, []
        if nodes:
            stack = [0]
            while stack:
                value, children = nodes[at := stack.pop()]
                d = (value ^ x).bit_count()
                if d <= radius:
                    found.append(at)
                stack.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
            at = 0
            while True:
                value, children = nodes[at]
                d = (value ^ x).bit_count()
                if d not in children:
                    children[d] = len(nodes)
                    break
                at = children[d]
        nodes.append((x, {}))
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a shard."""
    tree, root, out = Tree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.near_and_add(x & 0xFFFFFFFFFFFFFFFF, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((values[i], values[j]))
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): spanning links of the distinct fingerprints fps(fp); radius at most 3."""
    assert radius <= 3
    block = lambda i, width, col="fp": F.shiftrightunsigned(col, i * width).bitwiseAND((1 << width) - 1)
    first = fps.select("fp", F.explode(F.array(*[(block(i, 16) * 4 + i) for i in range(4)])).alias("k1"))
    hot = staged(first.groupBy("k1").count().where(F.col("count") > SHARD).select("k1", F.lit(True).alias("hot")), "shards")
    dealt = first.join(hot, "k1", "left")
    # The other 48 bits, whichever block the shard is of.
    i = F.col("k1") % 4
    rest = F.when(i == 0, F.shiftrightunsigned("fp", 16))
    for k in (1, 2, 3):
        low = F.col("fp").bitwiseAND((1 << (16 * k)) - 1)
        high = F.shiftleft(F.shiftrightunsigned("fp", 16 * (k + 1)), 16 * k) if k < 3 else F.lit(0).cast("long")
        rest = rest.when(i == k, high.bitwiseOR(low))
    second = F.array(*[(block(j, 12, "rest") * 4 + j) for j in range(4)])
    dealt = dealt.withColumn("rest", rest).select("fp", "k1", F.explode(F.when(F.col("hot"), second).otherwise(F.array(F.lit(-1).cast("long")))).alias("k2"))
    lone = dealt.groupBy("k1", "k2").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for fp_list in batch["fps"] for x in spanning_links(sorted(map(int, fp_list)), radius)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return lone.select("fps").mapInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    slim = staged(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "fp")
    nodes = staged(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    cc = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(cc, nodes["fp"] == cc["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = staged(rooted.join(least, "root").select("fp", "component_id"), "fp-ids")
    return slim.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
