"""First-wins de-duplication and the cleaning pipeline.

``row_number() = 1`` over a key is planned with a per-task group limit ahead of
the shuffle, so a key that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellframe.functions.identity import cross_file_key
from dwellframe.operators.filters import keep_computed


def keep_first(df: DataFrame, keys: list[str], order: list, exempt: Column | None = None) -> DataFrame:
    """First row per key in ``order``.

    ``exempt`` rows are all kept: each gets a private key made of the order
    columns, so they spread over all tasks instead of gathering under one blank key.
    Rows are sorted by the hash of their key first: long texts with equal beginnings
    are compared only where hashes are equal.
    """
    parts = list(keys)
    if exempt is not None:
        df = df.withColumn("_private", F.when(exempt, F.struct(*order)))
        parts.append("_private")
    if not isinstance(df.schema[parts[0]].dataType, T.LongType):  # a hash may be given as the first key
        df = df.withColumn("_hash", F.xxhash64(*parts))
        parts.insert(0, "_hash")
    w = Window.partitionBy(*parts).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return out.drop("_rn", "_private", "_hash")


def unique_titles(df: DataFrame, order: list[str], file: str = "feed_file", title: str = "title") -> DataFrame:
    """First row per title inside a file; blank titles stay."""
    blank = F.coalesce(F.btrim(title), F.lit("")) == ""
    return keep_first(df, [file, title], order, exempt=blank)


def with_cross_key(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("cross_key", cross_file_key(c("title"), c("community"), c("district"), c("source")))


def cross_file(main: DataFrame, others: DataFrame, rank: str, order: list[str]) -> DataFrame:
    """Keep every main row, and of the other classes the first row per key that main lacks.

    The key sides are reduced before they meet (one row per key each), and the
    window, the distinct and the anti join share one hash partitioning.
    """
    key_hash = F.xxhash64("cross_key").alias("_cross_hash")
    rest = keep_first(with_cross_key(others).select("*", key_hash), ["_cross_hash", "cross_key"], [rank, *order])
    held = with_cross_key(main).select(key_hash, "cross_key").distinct()
    fresh = rest.join(held, ["_cross_hash", "cross_key"], "left_anti")
    return main.unionByName(fresh.drop("_cross_hash", "cross_key"))


def unique_fingerprints(df: DataFrame, order: list[str], blanks: str = "keep") -> DataFrame:
    """First row per fingerprint; blank ones are all kept, or dropped."""
    blank = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    if blanks == "drop":
        return keep_first(keep_computed(df, ~blank), ["fingerprint"], order)
    return keep_first(df, ["fingerprint"], order, exempt=blank)


def survivors(repaired: DataFrame, order: list[str], rank: str = "feed_rank") -> DataFrame:
    """Rows left after the title and cross-file stages."""
    main = unique_titles(repaired.where(F.col(rank) == 0), order)
    return cross_file(main, repaired.where(F.col(rank) != 0), rank, order)


def clean(repaired: DataFrame, order: list[str], rank: str = "feed_rank") -> DataFrame:
    """All three stages: title in file, cross-file key, fingerprint."""
    return unique_fingerprints(survivors(repaired, order, rank), [rank, *order])


METRICS = ["total_read", "price_fixed", "cross_file_dup", "intra_file_dup_title", "final_count",
           "lng_ok", "fingerprint_dup"]


def clean_metrics(repaired: DataFrame, order: list[str], rank: str = "feed_rank") -> DataFrame:
    """One row of run metrics from three aggregates: rows read, main prices repaired, and rows surviving.

    Only main rows are repaired to be counted, as the others' repairs do not count.
    """
    main = F.col(rank) == 0
    read = repaired.agg(
        F.count("*").alias("read"), F.count_if(main).alias("main_read"), F.count_if(~main).alias("rest_read"))
    fixed = repaired.where(main).agg(F.count_if("price_fixed").alias("fixed"))
    left = survivors(repaired, order, rank)
    blank = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    kept = left.agg(
        F.count_if(main).alias("main_kept"), F.count_if(~main).alias("rest_kept"),
        F.count_if(F.col("lng").try_cast("double") > 0).alias("lng_ok"), F.count("*").alias("kept"),
        F.countDistinct(F.when(~blank, F.col("fingerprint"))).alias("keys"), F.count_if(blank).alias("blanks"))
    parts = [read, fixed, kept]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(
        *[F.sum(c).alias(c) for part in parts for c in part.columns])
    c = F.col
    return both.select(
        c("read").alias("total_read"), c("fixed").alias("price_fixed"),
        (c("rest_read") - c("rest_kept")).alias("cross_file_dup"),
        (c("main_read") - c("main_kept")).alias("intra_file_dup_title"),
        (c("keys") + c("blanks")).alias("final_count"), "lng_ok",
        (c("kept") - c("keys") - c("blanks")).alias("fingerprint_dup"))
