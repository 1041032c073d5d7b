"""Text helpers: blanks, prefixes, fallbacks and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def blank_to_null(c: Column) -> Column:
    """Trim; blank text and the literal 'nan' become null."""
    text = F.btrim(c)
    return F.when((text != "") & (text != "nan"), text)


def or_blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c) == "", F.lit(True))


def prefix(c: Column, n: int) -> Column:
    """First n characters (code points, not bytes)."""
    return F.left(c, F.lit(n))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_containing(items: Column, needle: str) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x.contains(needle)), F.lit(1))


def layout_text(layout: Column, rooms: Column, halls: Column, baths: Column) -> Column:
    """The stated layout, else one built from the room counts."""
    built = F.concat(
        rooms.cast("string"), F.lit("室"),
        F.coalesce(F.concat(halls.cast("string"), F.lit("厅")), F.lit("")),
        F.coalesce(F.concat(baths.cast("string"), F.lit("卫")), F.lit("")),
    )
    return F.coalesce(F.nullif(layout, F.lit("")), built, F.lit(""))


def title_text(title: Column, community: Column, fallback: str = "房源详情") -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(community, F.lit("")), F.lit(fallback))


def tag_text(c: Column) -> Column:
    """A display tag; blank and 'unknown' tags are hidden (null)."""
    return F.when((c != "") & (c != "未知"), c)


def compact_number(n: Column) -> Column:
    """10,000 and above as '1.2万', below as plain whole digits."""
    return F.when(n >= 10000, F.format_string("%.1f万", n / F.lit(10000.0))).otherwise(
        F.format_string("%.0f", n.cast("double")))


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(metres.cast("int").cast("string"), F.lit("m"))).otherwise(
        F.format_string("%.1fkm", metres / F.lit(1000.0)))


def parse_string_list(c: Column) -> Column:
    """JSON text to an array of strings; anything else becomes an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
