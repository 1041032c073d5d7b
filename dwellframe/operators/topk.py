"""Ordered results: paging, nearest, recommended and latest rows.

Each ends in ``orderBy(...).limit(k)``, which Spark runs as a per-partition
top-k followed by one merge of k rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.functions.geo import ellipsoid_m, haversine_m, within_degrees
from dwellframe.functions.text import distance_text
from dwellframe.operators.filters import has_coordinates


def page(df: DataFrame, order: str, page_no: int, page_size: int) -> DataFrame:
    """Page by offset; ``order`` must be unique."""
    if not 1 <= page_size <= 50 or page_no < 1:
        raise ValueError("page starts at 1 and page size lies in 1..50")
    return df.orderBy(order).offset((page_no - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, order: str, last, page_size: int) -> DataFrame:
    """Keyset page: deep pages sort no more than early ones.

    The filter reaches the scan only where ``order`` is a stored column; on a
    computed one every row is read and tested.
    """
    return df.where(F.col(order) > F.lit(last)).orderBy(order).limit(page_size)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def nearest(df: DataFrame, lat: float, lng: float, k: int, max_km: float | None = None,
            tie: str = "id", ellipsoid: bool = False) -> DataFrame:
    """The k listings closest to a point; rows without coordinates are left out.

    Distances are those on a sphere or, asked for, on the WGS84 ellipsoid.
    """
    rows = df.where(has_coordinates())
    if max_km is not None:
        rows = rows.where(within_degrees(F.col("lat"), F.col("lng"), lat, lng, max_km * 1000))
    measure = ellipsoid_m if ellipsoid else haversine_m
    metres = measure(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    rows = rows.withColumn("distance_m", metres)
    if max_km is not None:
        rows = rows.where(F.col("distance_m") <= max_km * 1000)
    return (rows.orderBy("distance_m", tie).limit(k)
            .withColumn("distance_text", distance_text(F.col("distance_m"))))


def recommended(df: DataFrame, k: int, tie: str = "id", first_page: int | None = None) -> DataFrame:
    """Dearest unit prices first, over everything or over the first page by id only."""
    rows = df.orderBy(tie).limit(first_page) if first_page else df
    return rows.orderBy(F.desc("unit_price"), tie).limit(k)


def log_history(log: DataFrame, limit: int = 20, source: str | None = None) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit lies in 1..100")
    rows = log.where(F.col("source") == source) if source else log
    return rows.orderBy(F.desc("crawl_time"), F.desc("id")).limit(limit)


def map_points(df: DataFrame, district: str | None = None, limit: int = 500, tie: str = "id") -> DataFrame:
    from dwellframe.operators.filters import finite_point
    rows = df.where(finite_point())
    if district:
        rows = rows.where(F.col("district") == district)
    return rows.orderBy(tie).limit(limit)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample without replacement: the n smallest hashes of the key."""
    return (df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
            .orderBy("_h", key).limit(n).drop("_h"))
