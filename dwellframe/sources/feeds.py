"""Raw listing feeds: CSV files whose names carry class and district."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellframe.functions.housing import price_was_fixed, repair_prices
from dwellframe.functions.identity import with_stored_fingerprint
from dwellframe.functions.numbers import as_double, positive, to_double, to_int
from dwellframe.functions.text import blank_to_null, strip_bom
from dwellframe.schema import SOURCE_A, SOURCE_B, STANDARD_FIELDS, all_strings

MAIN, MERGED, OTHER, SECOND = 0, 1, 2, 3

# File-name marks of the four feed classes, tested in this order.
CLASS_MARKS = [(MAIN, ["anjuke_m_"]), (SECOND, ["lianjia_"]),
               (MERGED, ["all_listings_merged", "anjuke_all"]), (OTHER, ["anjuke_"])]
DISTRICT_PREFIXES = ["anjuke_m_", "anjuke_fast_", "anjuke_", "lianjia_"]
RICH_PREFIXES = ["anjuke_fast_", "anjuke_detail_", "anjuke_"]


def read_feed(spark: SparkSession, path, layout: list[str] | None = None, multi_line: bool = False,
              tolerant: bool = False) -> DataFrame:
    """Read CSV feeds as text columns with their position.

    Every file is read by its own header: files with equal headers are read
    together and the groups are united by column name, so feeds with different
    layouts may lie under one path. ``layout`` names the columns to return;
    those a file lacks are null. Adds ``feed_file`` and the order columns
    ``block`` and ``line``: inside one split line numbers grow, splits of a file
    are ordered by their start, so (feed_file, block, line) is file order
    without reading a file in one task. ``tolerant`` skips unreadable files and
    returns nothing for a missing path.
    """
    reader = (spark.read.option("encoding", "UTF-8").option("recursiveFileLookup", True)
              .option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant))
    try:
        found = _headers(reader.text(path))
    except AnalysisException as e:
        if not tolerant or e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = {}
    reader = (reader.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
              .option("multiLine", multi_line).option("escape", '"'))
    out = None
    for header, files in found.items():
        names = [c.strip() for c in header]
        # The reader compares the header with the schema as written; the names are trimmed afterwards.
        df = reader.schema(all_strings(list(header))).csv(files).select(
            *[F.col(f"`{h}`").alias(c) for h, c in zip(header, names)],
            file_label(F.col("_metadata.file_path")).alias("feed_file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], all_strings(layout or []).add("feed_file", "string").add("block", "long").add("line", "long"))
    if layout is None:
        return out
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in layout],
                      "feed_file", "block", "line")


def _headers(lines: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Column names -> files. One line per file reaches the driver, which lists the files anyway."""
    path = F.col("_metadata.file_path")
    first = (lines.select("value", path.alias("file"), F.col("_metadata.file_block_start").alias("start"),
                          F.monotonically_increasing_id().alias("no"))
             .where((F.col("start") == 0) & (F.btrim("value") != ""))
             .groupBy("file").agg(F.min_by("value", "no").alias("head")))
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), F.col("file"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.select(decoded.alias("file"), "head").orderBy("file").collect():
        header = tuple(next(csv.reader([r.head.lstrip("\ufeff").rstrip("\r")])))
        out.setdefault(header, []).append(r.file)
    return out


def file_label(path: Column) -> Column:
    """The feed's file name; a partition folder ``feed_file=…`` stands for the file."""
    name = F.coalesce(F.nullif(F.regexp_extract(path, "feed_file=([^/]+)/", 1), F.lit("")),
                      F.regexp_extract(path, "([^/]+)$", 1))
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def feed_class(label: Column) -> Column:
    """Class rank by file name: main 0, merged 1, other 2, second source 3; null when unknown."""
    out = F.lit(None).cast("int")
    for rank, marks in reversed(CLASS_MARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | label.contains(m)
        out = F.when(hit, rank).otherwise(out)
    return out


def district_from_name(label: Column, scheme: str = "clean") -> Column:
    """District part of a file name under one of three naming habits.

    ``clean`` drops the first prefix that occurs, ``rich`` a leading prefix,
    ``update`` strips short prefixes first and therefore leaves 'fast_X'.
    """
    bare = F.replace(label, F.lit(".csv"), F.lit(""))
    if scheme == "update":
        for p in ("lianjia_", "anjuke_", "anjuke_fast_", "anjuke_detail_", "anjuke_m_"):
            bare = F.replace(bare, F.lit(p), F.lit(""))
        return bare
    out = bare
    for p in reversed(RICH_PREFIXES if scheme == "rich" else DISTRICT_PREFIXES):
        hit = label.startswith(p) if scheme == "rich" else label.contains(p)
        out = F.when(hit, F.replace(bare, F.lit(p), F.lit(""))).otherwise(out)
    return out


def feed_source(label: Column, rank: Column) -> Column:
    """Source A unless the file belongs to, or is named after, the second source."""
    return F.when((rank == SECOND) | label.contains("lianjia"), SOURCE_B).otherwise(SOURCE_A)


def normalise(df: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Alias and trim to the 23 standard text fields; absent fields become ''.

    When a feed has both ``id`` and ``source_id`` the later column wins, blank
    or not. District falls back to the file name, except for merged files.
    """
    present = df.columns
    cells: dict[str, Column] = {f: F.lit("") for f in STANDARD_FIELDS}
    for name in present:
        target = "source_id" if name == "id" else name
        if target in cells:
            cells[target] = F.coalesce(F.btrim(strip_bom(F.col(name).cast("string"))), F.lit(""))
    rank = feed_class(F.col("feed_file"))
    fallback = F.when(rank == MERGED, "").otherwise(district_from_name(F.col("feed_file")))
    cells["source"] = feed_source(F.col("feed_file"), rank)
    cells["district"] = F.when(cells["district"] == "", fallback).otherwise(cells["district"])
    rows = df.select(*[c.alias(f) for f, c in cells.items()], "feed_file", rank.alias("feed_rank"), *carry)
    # A record without an id takes its own key as id; the key is then built once more.
    own = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.col("fingerprint"))
    return with_stored_fingerprint(with_stored_fingerprint(rows).withColumn("source_id", own))


def repair(df: DataFrame) -> DataFrame:
    """Repair prices of every class but the second source; numbers become typed.

    ``price_fixed`` marks a change of more than one unit.
    """
    c = F.col
    rows = df.withColumns({
        "total_price": as_double(df, "total_price", 0.0),
        "unit_price": as_double(df, "unit_price"),
        "area": as_double(df, "area", 0.0),
    })
    rows = rows.withColumn("_before", c("total_price"))
    rows = repair_prices(rows, "total_price", "unit_price", "area", "title", c("feed_rank") != SECOND)
    rows = rows.withColumn("price_fixed", price_was_fixed(c("_before"), c("total_price"))).drop("_before")
    return with_stored_fingerprint(rows)


NUMBERS = {"total_price": to_double, "unit_price": to_double, "area": to_double, "lng": to_double,
           "lat": to_double, "rooms": to_int, "halls": to_int, "bathrooms": to_int,
           "total_floors": to_int, "build_year": to_int}


def typed(df: DataFrame, legacy_zeros: bool = False) -> DataFrame:
    """Typed columns with missing values as null, or as 0 and '' when ``legacy_zeros``."""
    out = {}
    for name in df.columns:
        if name in NUMBERS:
            value = NUMBERS[name](F.col(name).cast("string"))
            out[name] = F.coalesce(value, F.lit(0)) if legacy_zeros else positive(value)
        elif name in STANDARD_FIELDS:
            value = blank_to_null(F.col(name))
            out[name] = F.coalesce(value, F.lit("")) if legacy_zeros else value
    return df.withColumns(out)


def union_feeds(*frames: DataFrame, default_source: str | None = None) -> DataFrame:
    """Union by name; fields a feed lacks become null, a blank source takes the default."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if default_source is not None:
        out = out.withColumn("source", F.coalesce(blank_to_null(F.col("source")), F.lit(default_source)))
    return out


def write_feed(df: DataFrame, path: str, fields: list[str], by_file: bool = False, mode: str = "overwrite",
               mark: bool = False) -> None:
    """CSV sink with a fixed field list; other columns are dropped.

    ``mark`` puts a byte-order mark before the header of every file, as
    spreadsheet programs expect.
    """
    if mark:
        # The mark is part of the first header cell; readers of this module drop it.
        df = df.withColumnRenamed(fields[0], f"\ufeff{fields[0]}")
        fields = [f"\ufeff{fields[0]}", *fields[1:]]
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f)
            for f in fields]
    if by_file:
        df.select(*cols, "feed_file").write.partitionBy("feed_file").mode(mode).option("header", True) \
            .option("escape", '"').option("emptyValue", "").csv(path)
    else:
        df.select(*cols).write.mode(mode).option("header", True).option("escape", '"') \
            .option("emptyValue", "").csv(path)
