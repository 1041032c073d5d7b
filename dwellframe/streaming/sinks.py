"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a parquet folder; safe to repeat."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def drain_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Write each micro-batch's changed rows under its batch number.

    A repeated batch overwrites its own folder, so recovery never doubles rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def newest_versions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written version of every key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return picked.select(*keys, "_r.*")
