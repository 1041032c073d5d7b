"""Snapshots shown while a feed is still being read.

Each micro-batch adds its rows and its running totals, kept under its batch
number so that a repeated batch replaces its own. A snapshot is written after
the first batch and after every fifth, at once, and a last one, marked
complete, when the feed ends. It names the batch up to which its rows go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOTALS = "no long, batch long, running long, failed_so_far long, final boolean"


@dataclass
class Snapshots:
    spark: SparkSession
    path: str
    every: int = 5

    def _read(self, part: str) -> DataFrame:
        try:
            return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TOTALS)

    def _write(self, total: tuple, part: str) -> None:
        self.spark.createDataFrame([total], TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{part}")

    def _last(self, before: int) -> tuple[int, int, int, int]:
        """(number, batch, rows, failures) of the newest batch before one; zeros at the start."""
        rows = self._read("totals/*").where(F.col("batch") < before).orderBy(F.col("batch").desc()).take(1)
        return tuple(rows[0])[:4] if rows else (0, -1, 0, 0)

    def add(self, batch: DataFrame, batch_id: int, failed: Column) -> None:
        place = f"{self.path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        rows, bad = self.spark.read.schema(batch.schema).parquet(place).agg(F.count(F.lit(1)), F.count_if(failed)).first()
        no, _, running, failures = self._last(batch_id)
        total = (no + 1, batch_id, running + rows, failures + bad, False)
        self._write(total, f"totals/{batch_id}")
        if no == 0 or (no + 1) % self.every == 0:
            self._write(total, f"shown/{no + 1}")

    def follow(self, stream: DataFrame, checkpoint: str, failed: Column) -> None:
        """Reads all that is available; a further call goes on where this one ended."""
        (stream.writeStream.foreachBatch(lambda batch, batch_id: self.add(batch, batch_id, failed))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
        no, batch, running, failures = self._last(1 << 60)
        if no:
            self._write((no, batch, running, failures, True), f"shown/{no}")

    def shown(self) -> DataFrame:
        """(no, batch, running, failed_so_far, final) of every snapshot."""
        return self._read("shown/*")

    def rows(self, batch: int) -> DataFrame:
        """The rows of the snapshot that ends with a batch."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("batch") <= batch).drop("batch")
