"""Quota and synthetic-row queries."""

from pyspark.sql import functions as F

from dwellframe.functions.identity import stable_key
from dwellframe.operators import statistics as st
from dwellframe.operators import synth as sy
from dwellframe.operators.filters import real_only
from dwellframe.plans.registry import query
from dwellframe.plans.views import listings, on_listings
from dwellframe.session import stage

_COLS = ["id_key", "district", "community", "unit_price", "total_price", "area", "rooms", "halls", "bathrooms",
         "floor_type", "orientation", "decoration", "total_floors", "build_year", "lng", "lat"]
_QUOTA = """q AS (SELECT district, count(*) AS count, greatest(cast(floor({need} * (count(*) / cast((SELECT count(*) FROM listings) AS double)))
    AS bigint), 50) AS quota FROM listings GROUP BY district HAVING count(*) >= 10)"""


def _need(df):
    return df.count() // 4


@query("quota", "G1 A28", on_listings(f"WITH {_QUOTA.format(need='55000')} SELECT * FROM q"))
def quota(spark, sf):
    return sy.quotas(st.district_profile(listings(spark, sf, *_COLS)), 55000)


@query("quota_rows", "G2", on_listings(f"""
    WITH {_QUOTA.format(need="(SELECT count(*) // 4 FROM listings)")}
    SELECT district, quota AS rows, quota AS last_n, cast(quota * (quota + 1) / 2 AS bigint) AS sum_n FROM q"""))
def quota_rows(spark, sf):
    df = listings(spark, sf, *_COLS)
    rows = sy.number_rows(sy.quotas(st.district_profile(df), _need(df)))
    return rows.groupBy("district").agg(F.count("*").alias("rows"), F.max("n").alias("last_n"), F.sum("n").alias("sum_n"))


def _u(name):
    return f"('0x' || left(md5(concat('42|{name}|', district, '|', n)), 8))::bigint / 4294967296.0"


def _z(name, mean, std):
    return f"({mean} + {std} * (sqrt(-2.0 * ln(1.0 - {_u(name + '/r')})) * cos(2 * pi() * {_u(name + '/a')})))"


_CATS = ["rooms", "floor_type", "orientation", "decoration"]
_DRAWS = f"""{_QUOTA.format(need="(SELECT count(*) // 4 FROM listings)")},
    prof AS (SELECT district, avg(area) AS aa, stddev_samp(area) AS sa, avg(unit_price) AS au, stddev_samp(unit_price) AS su,
                    avg(build_year) AS ay FROM listings GROUP BY district),
    w AS ({' UNION ALL '.join(f"SELECT district, '{c}' AS d, cast({c} AS varchar) AS v, count(*) AS k FROM listings GROUP BY ALL" for c in _CATS)}),
    cw AS (SELECT district, d, v, sum(k) OVER (PARTITION BY district, d ORDER BY encode(v) ROWS UNBOUNDED PRECEDING) AS c FROM w),
    t AS (SELECT district, d, list({{'c': c, 'v': v}} ORDER BY c) AS l, max(c) AS total FROM cw GROUP BY ALL),
    g AS (SELECT q.district, unnest(range(1, quota + 1)) AS n FROM q),
    r AS (SELECT g.*, {', '.join(f"list_filter(t_{c}.l, lambda x: x.c >= {_u(c).replace('district', 'g.district')} * t_{c}.total)[1].v AS {c}" for c in _CATS)},
          least(cast(format('{{:.1f}}', greatest(15.0, {_z('area', 'aa', 'sa').replace('district', 'g.district')})) AS double), 400) AS area,
          least(cast(format('{{:.0f}}', greatest(500.0, {_z('unit', 'au', 'su').replace('district', 'g.district')})) AS double), 80000) AS unit_price,
          greatest(least(cast(trunc({_z('year', 'ay', '5.0').replace('district', 'g.district')}) AS int), 2025), 1980) AS build_year
          FROM g JOIN prof ON prof.district = g.district {' '.join(f"JOIN t t_{c} ON t_{c}.district = g.district AND t_{c}.d = '{c}'" for c in _CATS)})"""


@query("synthetic_draws", "G3 G4 G5 W10", on_listings(f"""WITH {_DRAWS}
    SELECT district, concat('aug_', district, '_', n) AS source_id, cast(rooms AS int) AS rooms, floor_type, orientation, decoration,
      area, unit_price, greatest(least(cast(format('{{:.2f}}', unit_price * area / 10000) AS double), 3000), 3) AS total_price, build_year FROM r"""))
def synthetic_draws(spark, sf):
    rows = _synthetic(spark, sf)
    return rows.select("district", "source_id", "rooms", "floor_type", "orientation", "decoration", "area", "unit_price",
                       "total_price", "build_year")


def _synthetic(spark, sf):
    df = listings(spark, sf, *_COLS)
    # Written once: the joins behind a listing are not run again by each of the passes over them.
    real = stage(df.withColumn("fingerprint", stable_key(F.col("id_key"))).drop("id_key"), "real")
    total = real.count()
    return sy.generate(real, total + total // 4)


@query("synthetic_rows", "G3 G4 G5 G6 G7")
def synthetic_rows(spark, sf):
    return _synthetic(spark, sf)


@query("synthetic_excluded", "G7", on_listings(f"""
    WITH {_QUOTA.format(need="(SELECT count(*) // 4 FROM listings)")}
    SELECT q.district, q.count AS real_rows, q.quota AS synthetic_rows FROM q"""))
def synthetic_excluded(spark, sf):
    real = listings(spark, sf, "district").withColumn("is_synthetic", F.lit(False))
    both = real.unionByName(_synthetic(spark, sf).select("district", "is_synthetic"))
    kept = real_only(both).groupBy("district").agg(F.count("*").alias("real_rows"))
    made = both.where("is_synthetic").groupBy("district").agg(F.count("*").alias("synthetic_rows"))
    return kept.join(made, "district")
