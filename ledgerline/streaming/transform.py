"""Bronze to Silver and quarantine as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import silver


def transform_new_rows(bronze: DataFrame, target: str, checkpoint: str, as_of: str) -> None:
    """Appends the Silver and quarantine rows of a streaming Bronze frame under `target`. Each batch
    replaces its own partition, so that a batch run again after a failure leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for name, df in (("authorizations", silver.authorizations(rows)), ("settlements", silver.settlements(rows)), ("quarantine", silver.quarantine(rows, as_of))):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{name}")
        rows.unpersist()

    bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
