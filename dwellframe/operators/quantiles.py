"""Exact median without gathering the column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_median(df: DataFrame, column: str) -> float | None:
    """Interpolated median of a numeric column; NaN and null are left out, infinities count.

    The range of finite values is cut into equal buckets; counts and bounds per
    bucket (at most ``BUCKETS`` rows) say which bucket holds the middle rank,
    and the next pass looks only there until a single value is left. Every pass
    narrows the range some thousandfold, so a handful of passes reaches
    neighbouring doubles. Equal values never need splitting.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = values.persist()
    try:
        v, finite = F.col("v"), F.abs("v") < math.inf
        lo, hi, n, low, high = values.agg(
            F.min(F.when(finite, v)), F.max(F.when(finite, v)), F.count("*"),
            F.count_if(v == -math.inf), F.count_if(v == math.inf)).first()
        if not n:
            return None

        def at(rank: int) -> float:
            if rank < low:
                return -math.inf
            return math.inf if rank >= n - high else _at_rank(values.where(finite), rank - low, lo, hi)

        lower = at((n - 1) // 2)
        if n % 2:
            return lower
        upto, following = values.agg(F.count_if(v <= lower), F.min(F.when(v > lower, v))).first()
        upper = lower if upto > n // 2 else following
        return lower if lower == upper else lower / 2 + upper / 2 if math.isinf(lower + upper) else (lower + upper) / 2
    finally:
        values.unpersist()


def _at_rank(values: DataFrame, rank: int, lo: float, hi: float) -> float:
    v = F.col("v")
    while lo < hi:
        # A span beyond the largest double is halved before it is cut.
        scale = 2.0 if math.isinf(hi - lo) else 1.0
        width = (hi / scale - lo / scale) / BUCKETS
        if width == 0 or lo / scale + width == lo / scale or hi / scale - width == hi / scale:
            bucket = v  # neighbouring doubles: each value is its own bucket
        else:
            bucket = F.least(F.floor((v / scale - lo / scale) / width), F.lit(BUCKETS - 1))
        inside = values.where(v.between(lo, hi))
        rows = (inside.groupBy(bucket.alias("b"))
                .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("b").collect())
        for r in rows:
            if rank < r.n:
                lo, hi = r.lo, r.hi
                break
            rank -= r.n
    return lo
