"""Streaming counters, de-duplication and freshness over event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellframe.functions.times import utc_instant


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 2) -> DataFrame:
    """Parquet folder as a stream; a zone-less ``ts`` becomes a UTC timestamp for watermarks."""
    df = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
    zoneless = "ts" in df.columns and isinstance(df.schema["ts"].dataType, T.TimestampNTZType)
    return df.withColumn("ts", utc_instant(F.col("ts"))) if zoneless else df


def _mark(df: DataFrame, watermark: str | None) -> DataFrame:
    return df.withWatermark("ts", watermark) if watermark else df


def window_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, by: list[str] = (),
                  watermark: str | None = None) -> DataFrame:
    """Rows and value sum per window; a sliding window gives the rolling counters.

    Without a watermark no late row is lost and the state is one row per window and group.
    """
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _mark(events, watermark).groupBy(w.alias("w"), *by).agg(
        F.count("*").alias("rows"), F.sum(F.floor("value").cast("bigint")).alias("total")).select(
        F.col("w.start").alias("start"), *by, "rows", "total")


def unique_feed(events: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """First arrival per key; a key's state is dropped once the watermark has passed it."""
    return _mark(events, watermark).dropDuplicatesWithinWatermark(keys)


def last_seen(events: DataFrame, key: str) -> DataFrame:
    """Latest confirmation per key; partial aggregation keeps hot keys cheap."""
    return events.groupBy(key).agg(F.max("ts").alias("last_seen"))


def snapshots(per_batch: DataFrame, every: int = 5) -> DataFrame:
    """Running totals shown after the first batch, every ``every`` batches and at the end.

    ``per_batch`` is one row per micro-batch.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("batch")
    rows = per_batch.withColumns({
        "no": F.row_number().over(order), "running": F.sum("rows").over(order),
        "failed_so_far": F.sum("failed").over(order), "final": F.lead("batch").over(order).isNull()})
    return rows.where((F.col("no") == 1) | (F.col("no") % every == 0) | F.col("final"))
