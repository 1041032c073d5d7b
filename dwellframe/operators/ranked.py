"""Pages of any depth from a rank index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.sources.sorted_files import open_files, write_sorted


@dataclass
class RankIndex:
    """Rows in the order of a unique column, with the number of rows ahead of every file.

    A page opens only the files that hold its ranks, so a deep page costs what
    the first one does.
    """

    spark: SparkSession
    path: str
    order: str

    @classmethod
    def build(cls, df: DataFrame, path: str, order: str, rows_per_file: int = 100_000) -> RankIndex:
        write_sorted(df, f"{path}/rows", f"{path}/files", order, rows_per_file)
        return cls(df.sparkSession, path, order)

    def count(self) -> int:
        return self._files().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def page(self, page_no: int, page_size: int) -> DataFrame:
        """The rows of a page; none beyond the last page."""
        if not 1 <= page_size <= 50 or page_no < 1:
            raise ValueError("page starts at 1 and page size lies in 1..50")
        first = (page_no - 1) * page_size
        # At most page_size files, as each of them holds a row of the page.
        held = self._files().where((F.col("start") < first + page_size) & (F.col("start") + F.col("rows") > first))
        hits = held.orderBy("start").collect()
        rows = open_files(self.spark, f"{self.path}/rows", [h["file"] for h in hits])
        skip = first - hits[0]["start"] if hits else 0
        return rows.orderBy(self.order).offset(skip).limit(page_size)
