"""Scoring of a stream of card features by a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model as models


def score_stream(features: DataFrame, path: str, target: str, checkpoint: str, version: str | None = None) -> None:
    """Scores what a streaming frame of card features has now: rows that keep the model's contract go to
    `target`/scored, the others, with the features they lack, to `target`/rejected. The model is read once and checked before any
    row is. Each batch replaces its own partition, so one that runs again after a failure leaves its rows once."""
    model = models.checked(models.load(features.sparkSession, path, version))

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in (("scored", models.scored(models.accepted(batch), model)), ("rejected", models.rejected(batch))):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{name}")

    features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
