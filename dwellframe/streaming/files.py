"""Watching a folder of feed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.schema import RAW_FIELDS_A, RAW_FIELDS_B
from dwellframe.sources.feeds import file_label, normalise
from dwellframe.sources.folder import watch_headed


def watch_feeds(spark: SparkSession, path: str, manifests: str,
                fields: list[str] = [*RAW_FIELDS_A, *(f for f in RAW_FIELDS_B if f not in RAW_FIELDS_A)]) -> DataFrame:
    """New CSV files as normalised rows, each file read by its own header.

    Layouts may lie mixed under one path; fields a file lacks are blank.
    ``manifests`` is a shared folder of this stream alone that remembers the files.
    """
    raw = watch_headed(spark, path, fields, manifests)
    # The feeds that know both an id and a source_id fill the later one.
    rows = raw.withColumn("feed_file", file_label(F.col("feed_path"))).drop("feed_path")
    if {"id", "source_id"} <= set(fields):
        rows = rows.withColumn("source_id", F.coalesce("source_id", "id")).drop("id")
    return normalise(rows)
