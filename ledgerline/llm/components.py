"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b; any order) but the roots, root the least node reachable.

    Each round is two aggregations (combined before the shuffle) and two joins on the node,
    which adaptive execution splits for hub nodes; rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder, and the one before it cleared. Self
    links and repeated links are ignored; nulls are not links. No edges give no rows."""
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        with scratch(spark) as write:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            # Large star: larger neighbours of u, to u's least neighbour.
            large = now.select(F.col("u").alias("x"), F.col("v").alias("u")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
            large = write(large, "cc")
            # Small star: u and its smaller neighbours, to the least of them.
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            old, now = now, staged(small, "cc")
        forget(spark, [os.path.dirname(f) for f in old.inputFiles()[:1]])
        # Only stars are left when each node has one parent and no parent has one of its own.
        once = now.groupBy("u").agg(F.count("*").alias("n"))
        parents = now.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1))
        if once.unionByName(parents).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
