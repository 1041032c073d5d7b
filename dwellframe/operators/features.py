"""The model feature table: trimming, fills, codes and target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.functions import housing as h
from dwellframe.functions.numbers import clip, finite
from dwellframe.operators.filters import real_only, valid_for_analysis, within_trim
from dwellframe.operators.quantiles import exact_median
from dwellframe.operators.statistics import grouped_mean
from dwellframe.session import stage

INPUTS = ["district", "community", "total_price", "unit_price", "area", "rooms", "halls", "bathrooms",
          "floor_type", "total_floors", "orientation", "decoration", "build_year", "status"]


def trimmed(df: DataFrame) -> DataFrame:
    """The real listings within the limits of the analysis."""
    return real_only(df).where(valid_for_analysis() & within_trim())


def storey_fill(rows: DataFrame) -> float:
    """Storey count for unknown ones: the exact median of the known."""
    known = rows.select(F.when(F.col("total_floors") > 0, F.col("total_floors")).cast("double").alias("total_floors"))
    fill = exact_median(known, "total_floors")
    return 20.0 if fill is None else fill


def prepared(df: DataFrame, as_of_year: int = 2026, legacy_zeros: bool = False, corrected: bool = False,
             storeys: float | None = None) -> DataFrame:
    """Trimmed rows with filled values and ordinal codes (no target is used yet).

    A year of 0 means unknown and becomes 2010; with ``legacy_zeros`` it is
    clipped to 1980 instead. Unknown storey counts take ``storeys``, else the
    exact median.
    """
    rows = trimmed(df)
    c = F.col
    year = c("build_year") if legacy_zeros else F.when(c("build_year") > 0, c("build_year"))
    rows = rows.withColumn("build_year", clip(F.coalesce(year, F.lit(2010)), 1980, 2025))
    floors = c("total_floors") if legacy_zeros else F.when(c("total_floors") > 0, c("total_floors"))
    known = rows.select(floors.cast("double").alias("total_floors"))
    if storeys is not None:
        floors = F.coalesce(floors.cast("double"), F.lit(storeys))
    elif known.where(F.col("total_floors").isNull()).limit(1).count():
        fill = exact_median(known, "total_floors")
        floors = F.coalesce(floors.cast("double"), F.lit(20.0 if fill is None else fill))
    return rows.withColumns({
        "total_floors": clip(floors.cast("double"), 1.0, 80.0),
        "halls": F.coalesce("halls", F.lit(1)), "bathrooms": F.coalesce("bathrooms", F.lit(1)),
    }).withColumns({
        "floor_type_code": h.floor_code(c("floor_type")),
        "decoration_code": h.decoration_code(c("decoration")),
        "orientation_code": h.orientation_code(c("orientation"), corrected),
        "floor_ratio": F.lit(0.5),
        "house_age": h.house_age(c("build_year"), as_of_year),
        "avg_room_area": h.area_per_room(c("area"), c("rooms"), c("halls"), c("bathrooms")),
    })


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Stable train/test flag from a hash of the row key: the same row always lands on the same side."""
    bucket = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.lit(8)), 16, 10)
    share = bucket.cast("bigint") / F.lit(4294967296.0)
    return df.withColumn("is_test", share < test_share)


def fold_by_hash(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    bucket = F.conv(F.left(F.md5(F.concat(F.lit(f"fold{seed}|"), F.col(key).cast("string"))), F.lit(8)), 16, 10)
    return df.withColumn("fold", (bucket.cast("bigint") % folds).cast("int"))


def target_encode(df: DataFrame, fit_on: str = "train", target: str = "unit_price",
                  district_min: int = 5, community_min: int = 3) -> DataFrame:
    """Mean target per district and community with minimum support.

    ``fit_on='train'`` fits on rows that are not ``is_test``, so the test rows'
    targets do not leak; ``'all'`` reproduces fitting before the split. Small
    districts take the median target, small communities their district's code.
    """
    basis = df.where(~F.col("is_test")) if fit_on == "train" else df
    return with_means(df, target_means(basis, target, district_min, community_min))


@dataclass
class Means:
    """Mean target per district and community, and the code of a place without one."""

    district: DataFrame
    community: DataFrame
    fallback: float | None


def target_means(basis: DataFrame, target: str = "unit_price", district_min: int = 5, community_min: int = 3) -> Means:
    fallback = exact_median(basis, target)
    district = grouped_mean(basis, "district", target, district_min).select("district", F.col("mean").alias("_dm"))
    community = grouped_mean(basis, "community", target, community_min).select("community", F.col("mean").alias("_cm"))
    return Means(district, community, fallback)


def with_means(df: DataFrame, means: Means) -> DataFrame:
    rows = df.join(means.district, "district", "left").join(means.community, "community", "left")
    code = F.coalesce("_dm", F.lit(means.fallback))
    return rows.withColumns({"district_encoded": code, "community_encoded": F.coalesce(F.col("_cm"), code)}).drop("_dm", "_cm")


def fill_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null, nulls the column's exact median.

    A column without nulls costs only the count that shows it.
    """
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    fills = {c: exact_median(df, c) for c in columns if holes[c]}
    return df.fillna({c: v for c, v in fills.items() if v is not None})


def standard_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns],
                  *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def standardise(df: DataFrame, columns: list[str], basis: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std fitted on ``basis``; a constant column is only centred."""
    s = standard_stats(basis if basis is not None else df, columns).first()
    return df.withColumns({
        c: (F.col(c) - F.lit(s[f"{c}_mean"])) / F.lit(s[f"{c}_std"] or 1.0) for c in columns})


def feature_table(df: DataFrame, key: str, as_of_year: int = 2026, fit_on: str = "train",
                  legacy_zeros: bool = False) -> DataFrame:
    """All features; the trimmed input is written once because several passes read it."""
    base = stage(trimmed(df), "features")
    rows = split_by_hash(prepared(base, as_of_year, legacy_zeros), key)
    return target_encode(rows, fit_on)


def folded_features(df: DataFrame, key: str, folds: int = 5, as_of_year: int = 2026) -> list[DataFrame]:
    """One feature table per fold of the training side; ``is_test`` marks the fold.

    Codes are fitted on the other folds only, so no fold sees its own targets.
    """
    base = stage(trimmed(df), "features")
    rows = fold_by_hash(split_by_hash(prepared(base, as_of_year), key).where(~F.col("is_test")), key, folds)
    rows = stage(rows, "folds")
    # Each is written once, as the fits of every target read it many times.
    return [stage(target_encode(rows.withColumn("is_test", F.col("fold") == i)), "fold") for i in range(folds)]
