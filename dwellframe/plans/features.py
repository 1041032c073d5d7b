"""Feature table, encoding, scaling and split queries."""

from pyspark.sql import functions as F

from dwellframe.operators import features as ft
from dwellframe.operators.quantiles import exact_median
from dwellframe.plans.registry import query
from dwellframe.plans.views import dealt_listings as listings, on_listings
from dwellframe.schema import MODEL_FEATURES

PREPARED = """prepared AS (SELECT id_key, district, community, total_price, unit_price, area, rooms, halls, bathrooms,
    cast(greatest(least(total_floors, 80), 1) AS double) AS total_floors,
    greatest(least({year}, 2025), 1980) AS build_year,
    CASE floor_type WHEN '低层' THEN 0 WHEN '高层' THEN 2 ELSE 1 END AS floor_type_code,
    CASE decoration WHEN '毛坯' THEN 0 WHEN '精装' THEN 2 WHEN '豪装' THEN 3 ELSE 1 END AS decoration_code,
    CASE WHEN orientation LIKE '%南%' THEN 3 WHEN orientation LIKE '%东%' THEN 1 ELSE 0 END AS orientation_code,
    greatest(least(2026 - greatest(least({year}, 2025), 1980), 50), 0) AS house_age,
    greatest(least(area / greatest(least(rooms + halls + bathrooms, 20), 1), 100), 5) AS avg_room_area,
    ('0x' || left(md5(concat('42|', id_key)), 8))::bigint / 4294967296.0 < 0.2 AS is_test
    FROM listings WHERE total_price > 0 AND total_price < 5000 AND area > 0 AND area < 500 AND rooms > 0 AND rooms <= 10
      AND status = 'on_sale' AND total_price > 5 AND total_price < 3000 AND unit_price > 500 AND unit_price < 100000
      AND area >= 15 AND area <= 400)"""
YEAR = "CASE WHEN build_year > 0 THEN build_year ELSE 2010 END"
ENCODED = """dm AS (SELECT district, avg(unit_price) AS m FROM prepared {where} GROUP BY 1 HAVING count(*) >= 5),
    cm AS (SELECT community, avg(unit_price) AS m FROM prepared {where} GROUP BY 1 HAVING count(*) >= 3),
    enc AS (SELECT p.*, coalesce(dm.m, (SELECT median(unit_price) FROM prepared {where})) AS district_encoded,
        coalesce(cm.m, dm.m, (SELECT median(unit_price) FROM prepared {where})) AS community_encoded
        FROM prepared p LEFT JOIN dm USING (district) LEFT JOIN cm USING (community))"""


def feature_input(spark, sf):
    return listings(spark, sf, "id_key", *ft.INPUTS)


@query("features", "M1 P6 P7 F19 F20 F21 F22 F23 J1", on_listings(f"""
    WITH {PREPARED.format(year=YEAR)}, {ENCODED.format(where="WHERE NOT is_test")}
    SELECT id_key, is_test::int AS is_test, area, rooms, halls, bathrooms, total_floors, house_age, floor_type_code,
      decoration_code, orientation_code, round(avg_room_area, 6) AS avg_room_area,
      round(district_encoded, 4) AS district_encoded, round(community_encoded, 4) AS community_encoded FROM enc"""))
def features(spark, sf):
    rows = ft.feature_table(feature_input(spark, sf), "id_key").select("id_key", "is_test", *MODEL_FEATURES)
    return rows.withColumns({"is_test": F.col("is_test").cast("int"), "avg_room_area": F.round("avg_room_area", 6),
                             "district_encoded": F.round("district_encoded", 4),
                             "community_encoded": F.round("community_encoded", 4)})


@query("features_legacy", "M1", on_listings(f"""
    WITH {PREPARED.format(year="build_year")}
    SELECT build_year, house_age, count(*) AS rows, round(avg(avg_room_area), 4) AS avg_room_area FROM prepared GROUP BY ALL"""))
def features_legacy(spark, sf):
    rows = ft.prepared(feature_input(spark, sf), legacy_zeros=True)
    return rows.groupBy("build_year", "house_age").agg(
        F.count("*").alias("rows"), F.round(F.avg("avg_room_area"), 4).alias("avg_room_area"))


@query("target_encoding", "M2 A23 J1", on_listings(f"""
    WITH {PREPARED.format(year=YEAR)}, {ENCODED.format(where="")}
    SELECT district, community, count(*) AS rows, round(max(district_encoded), 4) AS district_encoded,
           round(max(community_encoded), 4) AS community_encoded FROM enc GROUP BY ALL"""))
def target_encoding(spark, sf):
    rows = ft.target_encode(ft.prepared(feature_input(spark, sf)), fit_on="all")
    return rows.groupBy("district", "community").agg(
        F.count("*").alias("rows"), F.round(F.max("district_encoded"), 4).alias("district_encoded"),
        F.round(F.max("community_encoded"), 4).alias("community_encoded"))


@query("medians", "A24", on_listings("""
    SELECT 'unit_price' AS field, round(median(unit_price), 6) AS median FROM listings
    UNION ALL SELECT 'area', round(median(area), 6) FROM listings
    UNION ALL SELECT 'build_year', round(median(nullif(build_year, 0)), 6) FROM listings"""))
def medians(spark, sf):
    df = listings(spark, sf, "unit_price", "area", "build_year").withColumn(
        "build_year", F.when(F.col("build_year") > 0, F.col("build_year")))
    rows = [(c, round(exact_median(df, c), 6)) for c in ("unit_price", "area", "build_year")]
    return spark.createDataFrame(rows, "field string, median double")


@query("median_fill", "F24 A24", on_listings("""
    WITH x AS (SELECT id_key, CASE WHEN bathrooms > 0 THEN area / bathrooms END AS per_bath FROM listings)
    SELECT id_key, round(coalesce(per_bath, (SELECT median(per_bath) FROM x)), 6) AS per_bath FROM x"""))
def median_fill(spark, sf):
    df = listings(spark, sf, "id_key", "area", "bathrooms")
    ratio = F.when(F.col("bathrooms") > 0, F.col("area") / F.col("bathrooms")).otherwise(F.lit(float("inf")))
    rows = ft.fill_with_median(df.select("id_key", ratio.alias("per_bath")), ["per_bath"])
    return rows.withColumn("per_bath", F.round("per_bath", 6))


@query("standardize", "M4", on_listings(f"""
    WITH {PREPARED.format(year=YEAR)}, s AS (SELECT avg(area) am, stddev_pop(area) asd, avg(rooms) rm, stddev_pop(rooms) rsd
      FROM prepared WHERE NOT is_test)
    SELECT id_key, round((area - am) / asd, 6) AS area, round((rooms - rm) / rsd, 6) AS rooms FROM prepared, s"""))
def standardize(spark, sf):
    rows = ft.split_by_hash(ft.prepared(feature_input(spark, sf)), "id_key")
    rows = ft.standardise(rows, ["area", "rooms"], basis=rows.where(~F.col("is_test")))
    return rows.select("id_key", F.round("area", 6).alias("area"), F.round("rooms", 6).alias("rooms"))


@query("hash_split", "M3", on_listings("""
    SELECT id_key, (('0x' || left(md5(concat('42|', id_key)), 8))::bigint / 4294967296.0 < 0.2)::int AS is_test,
           cast(('0x' || left(md5(concat('fold42|', id_key)), 8))::bigint % 5 AS int) AS fold FROM listings"""))
def hash_split(spark, sf):
    rows = ft.fold_by_hash(ft.split_by_hash(listings(spark, sf, "id_key"), "id_key"), "id_key")
    return rows.withColumn("is_test", F.col("is_test").cast("int"))
