"""Stored tables: parquet and JDBC scans, loads, appends, slices and results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dwellframe.functions.text import prefix
from dwellframe.operators.dedupe import keep_first
from dwellframe.operators.filters import loadable
from dwellframe.schema import TEXT_WIDTHS


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan; projection and filter both reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """Database scan cut into ``parts`` ranges of a numeric key."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options).load())


def fit_widths(df: DataFrame) -> DataFrame:
    """Cut text columns to the stored widths."""
    return df.withColumns({c: prefix(F.col(c), n) for c, n in TEXT_WIDTHS.items() if c in df.columns})


def load_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """What a bulk load keeps: keyed rows with a price in (0, 5000], first row per fingerprint."""
    return fit_widths(keep_first(df.where(loadable()), ["fingerprint"], order))


def load_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Replace a table by the loadable rows."""
    load_rows(df, order).write.mode("overwrite").parquet(path)


def replace_slice(df: DataFrame, path: str, column: str, value: str) -> None:
    """Replace one slice of a partitioned table and leave the others untouched."""
    (df.where(F.col(column) == value).write.partitionBy(column).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


@dataclass(frozen=True)
class WriteCount:
    """Rows written, and how many of them the statement inserted or changed, or left out."""

    written: int
    changed: int


def _write_counted(df: DataFrame, path: str, mode: str, changed: Column, kept: Column) -> WriteCount:
    """Write the rows that ``kept`` holds for; the write itself observes the counts, so nothing is read twice."""
    seen = Observation()
    marked = df.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    counted = marked.observe(seen, F.count_if("_kept").alias("written"), F.count_if(changed).alias("changed"))
    counted.where("_kept").drop("_kept").write.mode(mode).parquet(path)
    return WriteCount(seen.get["written"], seen.get["changed"])


def insert(df: DataFrame, path: str) -> WriteCount:
    """Append rows."""
    return _write_counted(df, path, "append", F.lit(True), F.lit(True))


def update(df: DataFrame, path: str, sets: dict[str, Column], where: Column) -> WriteCount:
    """Write the next version of a table, with ``sets`` applied to the rows that ``where`` holds for.

    A row counts as changed only if one of its values becomes another one. The
    values are those before the statement on every right-hand side. ``path``
    must not be the folder that ``df`` reads.
    """
    hit = F.coalesce(where, F.lit(False))
    new = {f"_n_{c}": F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in sets.items()}
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in sets])
    rows = df.withColumns(new).withColumn("_differs", differs)
    out = rows.select(*[F.col(f"_n_{c}").alias(c) if c in sets else F.col(c) for c in df.columns], "_differs")
    seen = Observation()
    counted = out.observe(seen, F.count("*").alias("written"), F.count_if("_differs").alias("changed"))
    counted.drop("_differs").write.mode("errorifexists").parquet(path)
    return WriteCount(seen.get["written"], seen.get["changed"])


def delete(df: DataFrame, path: str, where: Column) -> WriteCount:
    """Write the next version of a table without the rows that ``where`` holds for; those count as changed."""
    gone = F.coalesce(where, F.lit(False))
    return _write_counted(df, path, "errorifexists", gone, ~gone)


def store_result(rows: DataFrame, path: str, analysis_type: str, create_time: Column) -> None:
    """Keep one result set per analysis type; rows are stored as JSON payloads."""
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    (rows.select(payload.alias("payload"), create_time.alias("create_time"),
                 F.lit(analysis_type).alias("analysis_type"))
     .write.partitionBy("analysis_type").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_result(spark: SparkSession, path: str, analysis_type: str, schema: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("analysis_type") == analysis_type)
    return rows.select(F.from_json("payload", schema).alias("r")).select("r.*")


def latest_per_type(df: DataFrame, key: str, time: str, tie: str, *columns: str) -> DataFrame:
    """Newest row per key as a partial aggregate, ties by the larger id."""
    newest = F.max_by(F.struct(*columns), F.struct(time, tie)).alias("_r")
    return df.groupBy(key).agg(newest).select(key, "_r.*")


def merge_keyed(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Old rows keep their first version per key; a new row replaces them, the last one winning."""
    first = keep_first(old.where(F.col(key) != ""), [key], order)
    last = keep_first(new.where(F.col(key) != ""), [key], [F.desc(c) for c in order])
    return first.join(last.select(key), key, "left_anti").unionByName(last)


def stats_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pending(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Found but not yet done."""
    return found.join(done.select(key).distinct(), key, "left_anti")


def parse_progress(df: DataFrame, column: str) -> DataFrame:
    """Progress JSON in the object form or the older bare page list."""
    obj = F.from_json(column, "struct<pages_done:array<int>,pages_failed:array<int>,total_crawled:int>")
    bare = F.from_json(column, "array<int>")
    is_list = F.btrim(F.col(column)).startswith("[")
    empty = F.array().cast("array<int>")
    return df.withColumns({
        "pages_done": F.coalesce(F.when(is_list, bare).otherwise(obj["pages_done"]), empty),
        "pages_failed": F.coalesce(F.when(~is_list, obj["pages_failed"]), empty),
        "total_crawled": F.coalesce(F.when(~is_list, obj["total_crawled"]), F.lit(0)),
    })


def progress_board(districts: DataFrame, progress: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Done, partial or not started, per district."""
    rows = (districts.join(progress, key, "left")
            .join(finished.select(key).distinct().withColumn("_has_file", F.lit(True)), key, "left"))
    pages = F.coalesce(F.col("pages_done"), F.lit(0))
    status = (F.when(F.col("_has_file"), "done").when(pages > 0, "partial").otherwise("not started"))
    return rows.select(key, pages.alias("pages_done"), status.alias("progress"))
