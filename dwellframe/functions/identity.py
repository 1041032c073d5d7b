"""Listing keys: fingerprints for storage and for cross-file matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellframe.functions.numbers import as_double, as_int, fixed_text, to_double
from dwellframe.functions.text import or_blank, prefix
from dwellframe.schema import SOURCE_B


def fingerprint(parts: list[Column], prefix_text: str = "", length: int = 32) -> Column:
    """md5 over '|'-joined parts, cut to ``length`` hex digits."""
    return F.concat(F.lit(prefix_text), F.left(F.md5(F.concat_ws("|", *parts)), F.lit(length)))


def with_stored_fingerprint(df: DataFrame) -> DataFrame:
    """Add the key of a cleaned listing; source B listings with an id use that id.

    The hash covers 60 characters of title, community, district, area and price
    with one decimal, and rooms.
    """
    c = F.col
    df = df.withColumns({"_area": as_double(df, "area", 0.0),
                         "_price": as_double(df, "total_price", 0.0)})
    hashed = fingerprint(
        [prefix(or_blank(c("title")), 60), or_blank(c("community")), or_blank(c("district")),
         fixed_text(c("_area"), 1), as_int(df, "rooms", 0).cast("string"),
         fixed_text(c("_price"), 1)],
        "ajk_", 16)
    sid = or_blank(c("source_id"))
    by_id = (c("source") == SOURCE_B) & (sid != "")
    return df.withColumn("fingerprint", F.when(by_id, F.concat(F.lit("lj_"), sid)).otherwise(hashed)).drop(
        "_area", "_price")


def with_feed_fingerprint(df: DataFrame) -> DataFrame:
    """Add the full-length key over community, district, area, rooms and price.

    A number that cannot be read prints as '0', a readable zero as '0.0'.
    """
    c = F.col

    def number(name: str) -> Column:
        if not isinstance(df.schema[name].dataType, T.StringType):
            return as_double(df, name, 0.0)
        text = F.btrim(c(name))
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(to_double(text))

    def shown(name: str) -> Column:
        return F.coalesce(fixed_text(c(name), 1), F.lit("0"))

    df = df.withColumns({"_area": number("area"), "_price": number("total_price")})
    key = fingerprint([or_blank(c("community")), or_blank(c("district")), shown("_area"),
                       as_int(df, "rooms", 0).cast("string"), shown("_price")])
    return df.withColumn("fingerprint", key).drop("_area", "_price")


def id_fingerprint(source_id: Column) -> Column:
    """Source B key; '' when there is no id."""
    sid = or_blank(source_id)
    return F.when(sid != "", F.concat(F.lit("lj_"), sid)).otherwise(F.lit(""))


def synthetic_fingerprint(title, community, district, area, rooms, total_price) -> Column:
    return fingerprint(
        [prefix(title, 60), community, district, fixed_text(area, 1), rooms.cast("string"),
         fixed_text(total_price, 2)],
        "aug_", 16)


def cross_file_key(title, community, district, source) -> Column:
    """Text key for matching across files; never empty because of its separators."""
    return F.concat_ws("|", prefix(or_blank(title), 80), or_blank(community), or_blank(district), source)


def stable_key(*columns: Column) -> Column:
    """Upsert key from columns that do not change over a listing's life."""
    return fingerprint([or_blank(c.cast("string")) for c in columns])
