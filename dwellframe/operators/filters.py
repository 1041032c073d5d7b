"""Row filters: search predicates, validity rules and presets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.functions.text import is_blank
from dwellframe.schema import ON_SALE, SOURCE_A, SOURCE_B

ANY = "全部"


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def keep_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are costly to compute.

    A plain ``where`` is pushed below the projection that makes those columns
    and evaluates their expressions a second time; a filter written as a
    generator stays above it.
    """
    kept = F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")
    return df.select("*", kept).drop("_kept")


def priced() -> Column:
    return (F.col("total_price") > 0) & (F.col("total_price") < 5000)


def has_coordinates() -> Column:
    return (F.col("lng") > 0) & (F.col("lat") > 0)


def has_real_images(column: str = "image_urls") -> Column:
    c = F.col(column)
    return c.isNotNull() & (c != "") & c.contains("http")


def search_predicate(
    district: str | None = None, min_price: float | None = None, max_price: float | None = None,
    min_area: float | None = None, max_area: float | None = None, rooms: int | None = None,
    floor_type: str | None = None, decoration: str | None = None, orientation: str | None = None,
    source: str | None = None, with_coords: bool = False, with_images: bool = False,
    wildcards: bool = False,
) -> Column:
    """One predicate from optional arguments; None and '' add nothing.

    ``wildcards`` keeps '%' and '_' in ``orientation`` as LIKE wildcards.
    """
    terms = [priced()]
    for column, value in (("district", district), ("floor_type", floor_type),
                          ("decoration", decoration), ("source", source)):
        if value:
            terms.append(F.col(column) == value)
    for column, low, high in (("total_price", min_price, max_price), ("area", min_area, max_area)):
        if low is not None:
            terms.append(F.col(column) >= low)
        if high is not None:
            terms.append(F.col(column) <= high)
    if rooms is not None:
        terms.append(F.col("rooms") == rooms)
    if orientation:
        c = F.col("orientation")
        terms.append(c.like(f"%{orientation}%") if wildcards else c.contains(orientation))
    if with_coords:
        terms.append(has_coordinates())
    if with_images:
        terms.append(has_real_images())
    return all_of(terms)


def search(df: DataFrame, **arguments) -> DataFrame:
    return df.where(search_predicate(**arguments))


def preset_arguments(**labels) -> dict:
    """Menu labels to search arguments; the 'all' label and None mean no filter."""
    return {k: v for k, v in labels.items() if v is not None and v != ANY}


# Menu choices (label, lower bound, upper bound), room values and source labels.
AREA_PRESETS = [
    ("不限", None, None), ("50m²以下", 0.0, 50.0), ("50-70m²", 50.0, 70.0), ("70-90m²", 70.0, 90.0),
    ("90-120m²", 90.0, 120.0), ("120-150m²", 120.0, 150.0), ("150-200m²", 150.0, 200.0),
    ("200m²以上", 200.0, None),
]
ROOM_PRESETS = [("全部", None), ("一室", 1), ("两室", 2), ("三室", 3), ("四室", 4), ("五室及以上", 5)]
SOURCE_LABELS = {"安居客": SOURCE_A, "链家": SOURCE_B, "贝壳": "beike", "我爱我家": "woaiwojia"}


def preset_counts(df: DataFrame) -> DataFrame:
    """Rows matched by every area preset, in one scan.

    Bands share their edges (both ends closed), so a row on an edge counts in two.
    """
    matches = [
        F.when(search_predicate(min_area=lo, max_area=hi), F.lit(label))
        for label, lo, hi in AREA_PRESETS
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*matches))).alias("preset"))
        .groupBy("preset").agg(F.count("*").alias("matches"))
    )


def valid_for_analysis() -> Column:
    """Priced on-sale rows with plausible area and room count."""
    return (priced() & (F.col("area") > 0) & (F.col("area") < 500)
            & (F.col("rooms") > 0) & (F.col("rooms") <= 10) & (F.col("status") == ON_SALE))


def within_trim() -> Column:
    """Open price ranges, closed area range."""
    return ((F.col("total_price") > 5) & (F.col("total_price") < 3000)
            & (F.col("unit_price") > 500) & (F.col("unit_price") < 100000)
            & (F.col("area") >= 15) & (F.col("area") <= 400))


def loadable() -> Column:
    """Rows the bulk load takes: keyed, and price in (0, 5000] (closed above)."""
    return ((F.coalesce(F.col("fingerprint"), F.lit("")) != "")
            & (F.col("total_price") > 0) & (F.col("total_price") <= 5000))


def real_only(df: DataFrame) -> DataFrame:
    """Leave generated rows out of analytics."""
    return df.where(~F.coalesce(F.col("is_synthetic"), F.lit(False))) if "is_synthetic" in df.columns else df


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)) == 0


def needs_enrichment(with_floor: bool = False) -> Column:
    """Any of coordinates, decoration, year, bathrooms (and floor text) missing."""
    missing = (_zero("lng") | is_blank(F.col("decoration")) | _zero("build_year") | _zero("bathrooms"))
    return missing | is_blank(F.col("floor_desc")) if with_floor else missing


def pending_images(df: DataFrame, source: str, limit: int | None = None, order: str = "id") -> DataFrame:
    rows = df.where((F.col("source") == source) & (F.col("image_urls").isNull() | (F.col("image_urls") == "")))
    rows = rows.orderBy(order)
    return rows.limit(limit) if limit else rows


def parsed_listing() -> Column:
    return (~is_blank(F.col("title"))) & (F.col("total_price") > 0)


def finite_point() -> Column:
    def ok(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok(F.col("lng")) & ok(F.col("lat"))


def district_subset(df: DataFrame, excluded: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not in ``excluded``."""
    return df.join(excluded, column, "left_anti")


def keyword_rules(df: DataFrame, limit: int = 10) -> DataFrame:
    """Rules that name both sides, best lift first."""
    named = df.where((~is_blank(F.col("antecedent"))) & (~is_blank(F.col("consequent"))))
    return named.orderBy(F.desc("lift"), "antecedent", "consequent").limit(limit)
