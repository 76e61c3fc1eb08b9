"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Tokens are summed by source and hash bucket; a running sum over the buckets finds the one in
which a source's budget ends, and only that bucket is refined, LEVELS times. What results is
one threshold for each source: a document is in if its hash is below, so nothing is sorted; the
one at the threshold is in by the words that are left. The shuffles carry at most
sources x BUCKETS sums; the number of sources is that of a label.

The hash is of doc_id and text, and then of a number each row gets when it is written, which
tells equal rows apart: whichever of them is in, the result has the same rows, so reruns agree.
Rows that tie in all its bits share what is left in proportion to their sizes.

Nulls: a null source is a source of its own, ranked last; a null text has size 0; a null
doc_id counts as any other value. Whole texts are counted, however long. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, staged, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS, TIES = 10, 6, 20
WEIGHTS = (5, 2, 1)


def word_count(name: str = "text"):
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size). A target is its source's weighted
    part of share x all sizes, at most `most` x source_size; the excess is reshared by weight.
    The sources that stop at their limit are those with the least limit per weight, so that
    one ordered pass over the sources replaces the rounds of resharing."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("limit", most * F.col("source_size"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("all_w", F.sum("w").over(everything))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("stops", F.col("limit") <= F.col("level") * F.col("w"))
    )
    # The level of the first source that does not stop holds for all later ones.
    final = F.min_by("level", F.when(~F.col("stops"), F.col("limit") / F.col("w"))).over(everything)
    return levels.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(F.least("limit", final * F.col("w"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken: whole repeats that all documents of the source
    get, one more for those below the source's threshold, and what is left for the one at it. A
    source misses its target by less than one word for each row at its threshold."""
    with scratch(docs.sparkSession) as write:
        content = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - BITS * LEVELS + TIES)
        slim = write(docs.select("doc_id", "source", word_count().alias("size"), content.alias("h"), F.monotonically_increasing_id().alias("row")), "mix")
        h = F.call_function("shiftleft", F.col("h"), F.lit(TIES)).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row"), 64 - TIES))
        slim = staged(slim.select("doc_id", "source", "size", h.alias("h")), "mix")
        targets = write(source_targets(slim, share, most, weights), "mix-targets").withColumnRenamed("source", "t_source")
        whole = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(int(most)))
        edge = targets.select("t_source", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
        for level in range(1, LEVELS + 1):
            shift = BITS * (LEVELS - level)
            above = shift + BITS
            held = slim.join(edge, F.col("source").eqNullSafe(F.col("t_source")) & (F.shiftright("h", above) == F.col("prefix")))
            hist = held.groupBy("t_source", "whole", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
            upto = Window.partitionBy("t_source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            hist = hist.withColumn("cum", F.sum("n").over(upto)).where(F.col("cum") > F.col("left"))
            edge = hist.groupBy("t_source").agg(F.min_by(F.struct("whole", (F.col("left") - F.col("cum") + F.col("n")).alias("left"), F.col("b").alias("prefix"), "n"), "b").alias("e")).select("t_source", "e.*")
            edge = write(edge, "mix-edge")
        at = edge.select(F.col("t_source").alias("b_source"), "prefix", "left", "n")
        plan = targets.join(at, F.col("t_source").eqNullSafe(F.col("b_source")), "left").select("t_source", "source_size", "target", whole.cast("long").alias("whole"), F.coalesce("prefix", F.lit(0)).alias("prefix"), F.coalesce(F.col("left") / F.col("n"), F.lit(0.0)).alias("part"))
        plan = staged(plan, "mix-plan")
    once = F.when(F.col("h") < F.col("prefix"), F.col("size")).when(F.col("h") == F.col("prefix"), F.round(F.col("part") * F.col("size")).cast("long")).otherwise(0)
    taken = F.least(F.col("whole") * F.col("size") + once, F.lit(int(most)) * F.col("size"))
    return slim.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
