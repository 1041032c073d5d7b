"""Listing rows as sets of 'dimension=value' items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellframe.functions.housing import bin_label
from dwellframe.functions.text import blank_to_null
from dwellframe.schema import AREA_BINS, TOTAL_PRICE_BINS, UNIT_PRICE_BINS

# Age bands in years.
AGE_BINS = ([5, 10, 15, 20], ["5年内", "5-10年", "10-15年", "15-20年", "20年+"])


def _item(dim: str, value: Column) -> Column:
    return F.concat(F.lit(dim + "="), value)


def listing_items(as_of_year: int = 2026) -> Column:
    """Up to ten items of a listing; a missing value gives no item."""
    col = F.col
    year = F.when(col("build_year") > 1980, col("build_year"))
    orient = blank_to_null(col("orientation"))
    return F.array_compact(F.array(
        _item("区县", blank_to_null(col("district"))),
        _item("单价", F.when(col("unit_price") > 0, bin_label(col("unit_price"), UNIT_PRICE_BINS))),
        _item("总价", F.when(col("total_price") > 0, bin_label(col("total_price"), TOTAL_PRICE_BINS))),
        _item("面积", F.when(col("area") > 0, bin_label(col("area"), AREA_BINS))),
        _item("户型", F.when(col("rooms") >= 5, "5室+").when(
            col("rooms") > 0, F.concat(col("rooms").cast("int").cast("string"), F.lit("室")))),
        _item("装修", blank_to_null(col("decoration"))),
        _item("楼层", blank_to_null(col("floor_type"))),
        _item("朝向", F.when(orient.contains("南"), "南向").when(orient.isNotNull(), "其他")),
        _item("房龄", F.when(year.isNotNull(), bin_label(F.lit(as_of_year) - year, AGE_BINS))),
        _item("来源", blank_to_null(col("source"))),
    ))


def item_dimension(item: Column) -> Column:
    return F.split_part(item, F.lit("="), F.lit(1))


def item_dimensions(items: Column) -> Column:
    return F.array_distinct(F.transform(items, item_dimension))


def itemset_text(items: Column) -> Column:
    return F.array_join(F.sort_array(items), ", ")
