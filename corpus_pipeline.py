"""The corpus pipeline: toxicity, near-duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
the columns of documents; the last returns the mix. No SQL expresses the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import op2_toxicity, op3_mixing, op7_pii, op10_decontamination
from ledgerline.llm.common import row_key, staged, table
from ledgerline.llm.similar import similar


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score reaches the threshold."""
    model = op2_toxicity.train(op2_toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return op2_toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the links between texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more: that of the least (doc_id, text hash),
    null ids last. Ids may be null or repeated; only rows equal in both id and text are one."""
    key = row_key("doc_id", "text").alias("near_key")
    rows = docs.select("doc_id", row_key("text").alias("h"), key).join(similar(docs), "h", "left")
    keep = rows.groupBy(F.coalesce("root", "h")).agg(F.min_by("near_key", F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("near_key"))
    return docs.withColumn("near_key", key).join(keep.select("near_key"), "near_key", "left_semi").dropDuplicates(["near_key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return op10_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes disclosing terms in the texts."""
    return op7_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    return op3_mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
