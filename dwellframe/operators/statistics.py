"""Grouped statistics over listing-shaped DataFrames.

All aggregates are partial-aggregation friendly: a value holding a third of all
rows is reduced to one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellframe.functions.housing import bin_label
from dwellframe.operators.filters import priced


def overview(df: DataFrame) -> DataFrame:
    return df.where(priced()).agg(
        F.count("*").alias("total_houses"),
        F.round(F.avg("unit_price"), 2).alias("avg_unit_price"),
        F.round(F.avg("total_price"), 2).alias("avg_total_price"),
        F.round(F.max("unit_price"), 2).alias("max_unit_price"),
        F.round(F.min("unit_price"), 2).alias("min_unit_price"),
        F.countDistinct("district").alias("district_count"),
    )


def latest(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias(f"latest_{column}"))


def counts_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def district_top(df: DataFrame, n: int = 20) -> DataFrame:
    return (
        df.where(priced()).groupBy("district")
        .agg(F.count("*").alias("count"),
             F.round(F.avg("unit_price"), 2).alias("avg_unit_price"),
             F.round(F.avg("total_price"), 2).alias("avg_total_price"))
        .orderBy(F.desc("count"), "district").limit(n)
    )


def district_detail(df: DataFrame, district: str | None = None) -> DataFrame:
    rows = df.where(priced())
    if district is not None:
        rows = rows.where(F.col("district") == district)
    return rows.groupBy("district").agg(
        F.count("*").alias("house_count"),
        F.round(F.avg("unit_price"), 2).alias("avg_unit_price"),
        F.round(F.avg("total_price"), 2).alias("avg_total_price"),
        F.round(F.avg("area"), 2).alias("avg_area"),
        F.round(F.max("total_price"), 2).alias("max_price"),
        F.round(F.min("total_price"), 2).alias("min_price"),
    )


def category_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Counts of a text category, blanks left out."""
    return df.where(F.col(column) != "").groupBy(*by, column).agg(F.count("*").alias("count"))


def room_counts(df: DataFrame, *by: str, upper: int | None = 10) -> DataFrame:
    keep = F.col("rooms") > 0
    if upper is not None:
        keep = keep & (F.col("rooms") <= upper)
    return df.where(keep).groupBy(*by, "rooms").agg(F.count("*").alias("count"))


def unit_price_by_rooms(df: DataFrame) -> DataFrame:
    rows = df.where((F.col("rooms") > 0) & (F.col("rooms") <= 10) & (F.col("unit_price") > 0))
    return rows.groupBy("rooms").agg(F.round(F.avg("unit_price"), 0).alias("avg_unit_price"))


def histogram(df: DataFrame, column: str, bins, keep: Column, *by: str) -> DataFrame:
    """Counts per labelled bin with the smallest value for ordering; empty bins are absent."""
    value = F.col(column)
    return (
        df.where(keep).groupBy(*by, bin_label(value, bins).alias("range"))
        .agg(F.count("*").alias("count"), F.round(F.min(value), 4).alias("bin_min"))
        .orderBy(*by, "bin_min")
    )


def top_per_group(df: DataFrame, group: str, value: str, n: int, measures: list[Column] = ()) -> DataFrame:
    """The n most frequent values of each group, ties by value."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("count"), *measures)
    w = Window.partitionBy(group).orderBy(F.desc("count"), value)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_communities(df: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(df.where(F.col("community") != ""), "district", "community", n,
                         [F.round(F.avg("unit_price"), 0).alias("avg_price")])


def quick_stats(df: DataFrame) -> DataFrame:
    """Headline numbers; the integer ones are cut after rounding to whole units."""
    return df.where(priced()).agg(
        F.count("*").alias("total_listings"),
        F.round(F.avg("unit_price"), 0).cast("bigint").alias("avg_unit_price"),
        F.round(F.avg("total_price"), 1).alias("avg_total_price"),
        F.round(F.avg("area"), 1).alias("avg_area"),
        F.round(F.avg("build_year"), 0).cast("bigint").alias("avg_build_year"),
    )


def recent_activity(df: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Rows first seen, and rows touched but known before, in the last hours (0 when empty)."""
    mark = as_of - F.expr(f"INTERVAL {hours} HOURS")
    return df.agg(
        F.count_if(F.col("first_seen") >= mark).alias("new_rows"),
        F.count_if((F.col("last_updated") >= mark) & (F.col("first_seen") < mark)).alias("updated_rows"),
    )


def _log_window(log: DataFrame, as_of, days: int) -> DataFrame:
    return log.where(F.col("crawl_time") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def daily_log(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _log_window(log, as_of, days).groupBy(F.to_date("crawl_time").alias("date")).agg(
        F.sum("new_added").alias("total_new"), F.sum("updated").alias("total_updated"),
        F.countDistinct("source").alias("sources"))


def source_log(log: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _log_window(log, as_of, days).groupBy("source").agg(
        F.count("*").alias("total_runs"), F.sum("new_added").alias("total_new"),
        F.sum("updated").alias("total_updated"), F.max("crawl_time").alias("last_crawl"))


def image_coverage(df: DataFrame) -> DataFrame:
    has = F.count_if(F.col("image_urls").isNotNull() & (F.col("image_urls") != ""))
    return df.groupBy("source").agg(
        F.count("*").alias("total"), has.alias("has_images"),
        F.round(100.0 * has / F.count("*"), 1).alias("pct"))


def source_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count("*").alias("cnt"), F.round(F.avg("unit_price"), 0).alias("avg_unit_price"),
        F.round(F.avg("total_price"), 1).alias("avg_total_price"),
        F.round(F.avg("area"), 1).alias("avg_area"))


def store_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.countDistinct("district").alias("districts"),
        F.count_if(F.col("lng") > 0).alias("with_coords"),
        F.round(100.0 * F.count_if(F.col("lng") > 0) / F.count("*"), 1).alias("coord_pct"),
        F.count_if(F.col("status") == "on_sale").alias("on_sale"))


def on_sale_summary(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "on_sale").agg(
        F.count("*").alias("on_sale"), F.round(F.avg("total_price"), 1).alias("avg_total_price"),
        F.round(F.avg("unit_price"), 0).alias("avg_unit_price"))


def price_span(df: DataFrame, low: float = 1) -> DataFrame:
    rows = df.where((F.col("total_price") > low) & (F.col("total_price") < 5000))
    return rows.agg(
        F.count("*").alias("samples"), F.round(F.min("total_price"), 1).alias("min_price"),
        F.round(F.avg("total_price"), 1).alias("avg_price"), F.round(F.max("total_price"), 1).alias("max_price"))


def missing_profile(df: DataFrame, *by: str) -> DataFrame:
    """Missing counts of the enrichable fields in one pass."""
    def zero(c): return F.count_if(F.coalesce(F.col(c), F.lit(0)) == 0)
    def blank(c): return F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), zero("lng").alias("missing_lng"),
        blank("decoration").alias("missing_decoration"), blank("floor_desc").alias("missing_floor_desc"),
        zero("build_year").alias("missing_build_year"), zero("bathrooms").alias("missing_bathrooms"),
        blank("source_id").alias("missing_id"))


def coverage(df: DataFrame) -> DataFrame:
    """Share of rows with coordinates, decoration and year."""
    n = F.count("*")
    def pct(c): return F.round(100.0 * F.count_if(c) / F.greatest(n, F.lit(1)), 1)
    return df.agg(n.alias("rows"), pct(F.col("lng") > 0).alias("coord_pct"),
                  pct(F.col("decoration") != "").alias("decoration_pct"),
                  pct(F.col("build_year") > 0).alias("year_pct"))


def grouped_mean(df: DataFrame, key: str, value: str, min_count: int) -> DataFrame:
    return (df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("support"))
            .where(F.col("support") >= min_count))


def district_ranking(df: DataFrame) -> DataFrame:
    return df.groupBy("district").agg(
        F.count("unit_price").alias("count"), F.avg("unit_price").alias("avg_unit_price"),
        F.avg("total_price").alias("avg_total_price"), F.avg("area").alias("avg_area"))


def top_by(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shares(counts: DataFrame, count: str = "count", by: list[str] | None = None, digits: int = 1) -> DataFrame:
    """Percent of the total, rounded and cut; ``counts`` is already one row per category.

    The overall total is a scalar subquery, so no ungrouped window sorts the categories.
    """
    if by:
        total = F.sum(count).over(Window.partitionBy(*by))
    else:
        total = counts.agg(F.sum(count)).scalar()
    rows = counts.withColumn("_part", F.col(count) * 100.0 / total)
    return rows.withColumn("pct", F.round("_part", digits)).withColumn(
        "pct_int", F.floor("_part")).drop("_part")


def pages_for(df: DataFrame, page_size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(page_size)).alias("pages"))


def dominant(df: DataFrame, group: str, column: str, alias: str | None = None) -> DataFrame:
    """Most frequent value of each group; ties go to the smaller text."""
    counted = df.groupBy(group, column).agg(F.count("*").alias("_n"))
    rank = F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))
    return counted.groupBy(group).agg(F.min(rank).alias("_top")).select(
        group, F.col("_top.v").alias(alias or column))


def residual_stats(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    r = F.col(truth) - F.col(predicted)
    return df.agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"))


def frame_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.round(F.min("total_price"), 0).alias("min_price"),
        F.round(F.max("total_price"), 0).alias("max_price"), F.round(F.avg("unit_price"), 0).alias("avg_unit_price"),
        F.countDistinct("district").alias("districts"), F.countDistinct("community").alias("communities"))


def district_profile(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """Distribution parameters per district for the generator; small districts are left out."""
    def pos(c): return F.when(F.col(c) > 0, F.col(c))
    return df.groupBy("district").agg(
        F.count("*").alias("count"),
        *[f(c).alias(f"{n}_{c}") for c in ("unit_price", "total_price", "area")
          for n, f in (("avg", F.avg), ("std", F.stddev_samp))],
        F.avg("total_floors").alias("avg_floors"), F.avg("build_year").alias("avg_build_year"),
        *[f(pos(c)).alias(f"{c}_{n}") for c in ("lng", "lat")
          for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
    ).where(F.col("count") >= min_rows)


def category_weights(df: DataFrame, columns: list[str], group: str = "district") -> DataFrame:
    """Long table (group, dimension, value, weight) of category counts, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return (df.select(group, F.explode(pairs).alias("p"))
            .groupBy(group, F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value"))
            .agg(F.count("*").alias("weight")))


def cumulative_weights(weights: DataFrame, group: str = "district") -> DataFrame:
    """Running sum of weights inside each (group, dimension), ordered by value."""
    w = (Window.partitionBy(group, "dimension").orderBy("value")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return weights.withColumn("cumulative", F.sum("weight").over(w))
