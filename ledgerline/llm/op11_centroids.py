"""k-means over integer vectors, with bounds that moved centroids loosen only as far as geometry asks.

Every vector carries its cluster, an upper bound u on the distance to its centroid and a lower
bound l[j] on the distance to each other one. When centroids move, u grows by its own centroid's
drift. A lower bound need not shrink by the whole drift of centroid j: the vectors of cluster i lie
in a sphere about i's old centroid, and in the plane through that and j's move from c to c'

    d(x, c) - d(x, c') <= |c - c'| * cos(angle at the move's midpoint between the move and x),

so the loss is the drift times the largest cosine over the angle under which the midpoint sees the
sphere: all of it only where the sphere holds the midpoint or lies ahead of the move, none where it
lies behind. Vectors whose bounds still part them from all other centroids keep their cluster
unread; the others are ambiguous and are scanned exactly, in integers.

Each round is one pass over the vectors, without a shuffle: changed vectors alone enter the sums
of the clusters they leave and join, which Spark adds up in tasks first. The driver holds k
centroids, k sums and k radii. Rounds are written to the shared folder and the one before cleared.

Kept are vectors of exactly `size` components, none null or not finite. A component beyond
+-2^26 after scaling leaves its vector out as well, since squared distances must fit a long. Repeated rows are
rows of their own; a null id is hashed as an empty one; equal hashes go by components. Of fewer
vectors than k each is a centroid; an empty table gives no rows. Columns other than the id and
the vector are ignored. Length of text does not apply.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, session, staged, table

K, ROUNDS, SIZE, SCALE, SEED, MOST = 8, 10, 64, 1024, 3, 1 << 26
#: Bounds are floats: this much is given away, far more than rounding can take.
SLACK = 1e-9
STATE = "vec_id long, x array<int>, cluster int, was int, u double, l array<double>, scanned boolean"


def kept(vectors: DataFrame, vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """(vec_id, x): the whole vectors, scaled and floored."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = (F.size(vector) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < float(MOST)))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least hashes of their ids; no more than k rows of a task are held."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(named.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def losses(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """loss[i, j]: how much nearer centroid j can have come to any vector of cluster i, all of
    which are within radius[i] of old[i]."""
    move = (new - old).astype(np.float64)
    drift = np.sqrt((move**2).sum(1))
    mid = (new + old) / 2.0
    out = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(drift):
        to = old - mid[j]
        far = np.sqrt((to**2).sum(1))
        angle = np.arccos(np.clip(to @ move[j] / np.maximum(far, 1e-300) / drift[j], -1, 1))
        seen = np.where(far > radius, np.arcsin(np.clip(radius / np.maximum(far, 1e-300), 0, 1)), np.pi)
        out[:, j] = drift[j] * np.clip(np.cos(np.maximum(0.0, angle - seen)), 0, 1)
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, centre in enumerate(c):
        d = x - centre
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, new: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None) -> DataFrame:
    """STATE under the centroids `new`: by bounds where those suffice, else by an exact scan. Without
    `old` (rows of vec_id and x) all are scanned."""
    k = len(new)
    loss = losses(old, new, radius) if old is not None else None
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) if old is not None else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.schema.names.index
            x = matrix(batch.column(at("x")), np.int64)
            if loss is None:
                was, u, low, open_ = np.full(n, -1), np.zeros(n), np.zeros((n, k)), np.ones(n, bool)
                cluster = was.copy()
            else:
                was = batch.column(at("cluster")).to_numpy().astype(np.int64)
                u = batch.column(at("u")).to_numpy() + drift[was]
                low = matrix(batch.column(at("l")), np.float64) - loss[was]
                cluster = was.copy()
                low[np.arange(n), was] = np.inf
                # One exact distance first: a tight u settles most.
                open_ = low.min(1) <= u * (1 + SLACK) + SLACK
                d = x[open_] - new[was[open_]]
                u[open_] = np.sqrt(np.einsum("ij,ij->i", d, d))
                open_ &= low.min(1) <= u * (1 + SLACK) + SLACK
                low[np.arange(n), was] = 0.0
            if open_.any():
                d = squared(x[open_], new)
                cluster[open_] = d.argmin(1)
                root = np.sqrt(d)
                u[open_] = root[np.arange(len(d)), cluster[open_]]
                low[open_] = root
            low = np.maximum(low, 0.0)
            yield pa.RecordBatch.from_arrays([
                batch.column(at("vec_id")), batch.column(at("x")), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(u), lists(low, pa.float64()), pa.array(open_),
            ], names=["vec_id", "x", "cluster", "was", "u", "l", "scanned"])

    return state.mapInArrow(each, STATE)


def changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the round changes in each cluster's count and sums, and each cluster's radius."""
    radius, count, sums = np.zeros(k), np.zeros(k, object), np.zeros((k, size), object)
    for r in state.groupBy("cluster").agg(F.max("u").alias("r")).collect():
        radius[r["cluster"]] = r["r"] * (1 + SLACK) + SLACK
    moved = state.where("cluster <> was").select("x", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))).alias("e"))
    signed = moved.where("e.c >= 0").groupBy("e.c").agg(F.sum("e.s").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("long") * F.col("e.s")) for i in range(size)]).alias("sums"))
    for r in signed.collect():
        count[r["c"]], sums[r["c"]] = r["n"], np.array(r["sums"], object)
    return count, sums, radius


def cluster(vectors: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """STATE after `rounds` moves of the centroids and one more assignment, those centroids, and how
    many vectors each assignment scanned. Centroids that stay end the rounds, as no later one differs."""
    spark = session(vectors)
    state = staged(kept(vectors, vector, size), "op11-kept")
    c = first_centroids(state, k, seed)
    if not len(c):
        return spark.createDataFrame([], STATE), np.zeros((0, size), np.int64), []
    count, sums, scans = np.zeros(len(c), object), np.zeros((len(c), size), object), []
    old, radius = None, None
    for at in range(rounds + 1):
        before, state = state, staged(assigned(state, c, old, radius), "op11-round")
        forget(spark, [os.path.dirname(f) for f in before.inputFiles()[:1]])
        scans.append(state.where("scanned").count())
        if at == rounds:
            break
        n, s, radius = changes(state, len(c), size)
        count, sums, old = count + n, sums + s, c
        c = np.array([[int(v) // int(m) for v in t] if m else list(o) for t, m, o in zip(sums, count, old)], np.int64)
        if (c == old).all():
            break
    return state, c, scans


def distance(c: np.ndarray) -> Column:
    """The squared distance of x to its cluster's centroid."""
    centre = F.element_at(F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in c]), F.col("cluster") + 1)
    return F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b).cast("long") * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, c, _ = cluster(table(spark, sf_dir, "embeddings"))
    if not len(c):
        none = {"distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return state.select("vec_id", "cluster", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    rows = state.select("vec_id", "cluster", distance(c).alias("distance"))
    # A row for each cluster, k at most.
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for j in sums]
    each = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
