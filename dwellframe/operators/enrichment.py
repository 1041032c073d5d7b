"""Lookups that fill or replace listing fields.

The lookup side is always reduced to one row per key first, so a left join
never multiplies rows and a hot key costs one lookup row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.functions.housing import complete_bathrooms, complete_unit_price
from dwellframe.functions.text import is_blank
from dwellframe.operators.increment import one_per_key


def _own_key(rows: DataFrame, key: str) -> Column:
    """The key as text, or for a blank key one that matches nothing, so blank rows do not meet in one task."""
    text = F.col(key).cast("string")
    return F.when(is_blank(text), F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))).otherwise(text)


def _look_up(rows: DataFrame, detail: DataFrame, key: str, names: dict[str, str], order: str | None) -> DataFrame:
    """Left join with one detail row per key: the last by ``order``, else the greatest row."""
    side = detail.where(~is_blank(F.col(key).cast("string")))
    side = side.select(F.col(key).cast("string").alias("_key"), *[F.col(c).alias(n) for c, n in names.items()],
                       (F.col(order) if order else F.struct(*names)).alias("_order"))
    side = one_per_key(side, "_key", "_order").drop("_order")
    return rows.withColumn("_own", _own_key(rows, key)).join(side, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")


def first_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key -> the value that came first."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def last_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def match_titles(rows: DataFrame, scanned: DataFrame, title: str, value: str, order: str,
                 by: list[str] = ()) -> DataFrame:
    """Fill an id by title (inside ``by``); the first id seen for a title wins, a blank title matches none."""
    known = (scanned.where(~is_blank(F.col(title))).groupBy(*by, F.col(title).alias("_key"))
             .agg(F.min_by(value, order).alias("matched")))
    rows = rows.withColumn("_own", _own_key(rows, title))
    known = known.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.col("_own") == F.col("_key")
    for c in by:
        same = same & (F.col(c) == F.col(f"_by_{c}"))
    return rows.join(known, same, "left").drop("_own", "_key", *[f"_by_{c}" for c in by])


def fallback_lookup(rows: DataFrame, table: DataFrame, key: str, value: str, candidates: list[Column]) -> DataFrame:
    """First candidate key with an entry gives the value; ``table`` has one row per key.

    Rows without a candidate get a key of their own that matches nothing, so
    they do not all meet in the task of the blank key.
    """
    found, own = [], F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))
    for i, candidate in enumerate(candidates):
        probe = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        rows = rows.withColumn(f"_c{i}", F.coalesce(F.nullif(candidate, F.lit("")), own))
        rows = rows.join(probe, F.col(f"_c{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    drop = [f"_{p}{i}" for i in range(len(candidates)) for p in "ckv"]
    return rows.withColumn("looked_up", F.coalesce(*found)).drop(*drop)


def _missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    return is_blank(F.col(c)) if kind == "string" else F.coalesce(F.col(c), F.lit(0)) == 0


# Fields filled together: the first decides, the rest follow it.
FIELD_GROUPS = [["lng", "lat"], ["decoration"], ["build_year"], ["bathrooms"],
                ["total_floors", "floor_type", "floor_desc"], ["unit_price"]]


def fill_missing(rows: DataFrame, detail: DataFrame, key: str, groups=FIELD_GROUPS, order: str | None = None) -> DataFrame:
    """Take detail values only where the row has none; ``filled`` counts the groups taken.

    Of several detail rows for a key the last by ``order`` counts.
    """
    groups = [[c for c in g if c in detail.columns] for g in groups]
    groups = [g for g in groups if g and g[0] in rows.columns]
    names = {c: f"_d_{c}" for g in groups for c in g}
    joined = _look_up(rows, detail, key, names, order)
    takes, updates = [], {}
    for g in groups:
        take = _missing(joined, g[0]) & ~_missing(joined, names[g[0]])
        takes.append(F.coalesce(take, F.lit(False)))
        for c in g:
            updates[c] = F.when(takes[-1], F.col(names[c])).otherwise(F.col(c))
    filled = sum((t.cast("int") for t in takes), F.lit(0))
    return joined.withColumns({**updates, "filled": filled}).drop(*names.values())


def complete(rows: DataFrame) -> DataFrame:
    """Derive unit price and bathrooms that are still missing."""
    c = F.col
    return rows.withColumns({
        "unit_price": complete_unit_price(c("unit_price"), c("total_price"), c("area")),
        "bathrooms": complete_bathrooms(c("bathrooms"), c("layout"), c("rooms")),
    })


def overwrite_present(rows: DataFrame, detail: DataFrame, key: str, groups=FIELD_GROUPS, order: str | None = None) -> DataFrame:
    """Detail values replace stored ones wherever the detail has a value; the last detail row by ``order`` counts."""
    groups = [[c for c in g if c in detail.columns] for g in groups]
    groups = [g for g in groups if g]
    names = {c: f"_d_{c}" for g in groups for c in g}
    joined = _look_up(rows, detail, key, names, order)
    updates, touched = {}, F.lit(False)
    for g in groups:
        has = F.coalesce(~_missing(joined, names[g[0]]), F.lit(False))
        touched = touched | has
        for c in g:
            updates[c] = F.when(has, F.col(names[c])).otherwise(F.col(c))
    return joined.withColumns({**updates, "touched": touched}).drop(*names.values())
