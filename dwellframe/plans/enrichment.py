"""Lookup and enrichment queries."""

from pyspark.sql import functions as F

from dwellframe.functions import housing
from dwellframe.functions.numbers import round_half_even
from dwellframe.operators import enrichment as en
from dwellframe.plans.registry import query
from dwellframe.plans.views import dealt_listings as listings, on_listings, table


@query("title_id_match", "J5", on_listings("""
    WITH scanned AS (SELECT district, title, id_key FROM listings WHERE feed_rank = 1),
         known AS (SELECT district, title, min(id_key) AS matched FROM scanned GROUP BY ALL)
    SELECT l.id_key, k.matched FROM listings l LEFT JOIN known k ON l.district = k.district AND l.title = k.title
    WHERE l.feed_rank = 0"""))
def title_id_match(spark, sf):
    df = listings(spark, sf, "district", "title", "id_key", "feed_rank")
    scanned = df.where("feed_rank = 1").drop("feed_rank")
    rows = df.where("feed_rank = 0").drop("feed_rank")
    return en.match_titles(rows, scanned, "title", "id_key", "id_key", by=["district"]).select("id_key", "matched")


@query("id_fallback_lookup", "J6", on_listings("""
    WITH m AS (SELECT community || '|' || title AS k, max(id_key) AS v FROM listings WHERE feed_rank = 1 GROUP BY 1
               UNION ALL SELECT title, max(id_key) FROM listings WHERE feed_rank = 2 GROUP BY 1)
    SELECT l.id_key, coalesce(a.v, b.v, c.v) AS looked_up FROM listings l
    LEFT JOIN m a ON a.k = l.community || '|' || l.title LEFT JOIN m b ON b.k = l.title
    LEFT JOIN m c ON c.k = 'Brand#1|' || l.title WHERE l.feed_rank = 3"""))
def id_fallback_lookup(spark, sf):
    df = listings(spark, sf, "community", "title", "id_key", "feed_rank")
    pair = F.concat_ws("|", "community", "title")
    entries = df.where("feed_rank = 1").select(pair.alias("k"), F.col("id_key").alias("v")).unionByName(
        df.where("feed_rank = 2").select(F.col("title").alias("k"), F.col("id_key").alias("v")))
    known = en.last_per_key(entries, "k", "v", "v")
    return en.fallback_lookup(
        df.where("feed_rank = 3"), known, "k", "v",
        [pair, F.col("title"), F.concat(F.lit("Brand#1|"), "title")]).select("id_key", "looked_up")


_DETAIL_SQL = """d AS (SELECT p_partkey AS part_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('装', p_type) END AS deco,
      CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1990 + p_size % 30 END AS yr, p_size % 2 AS ba,
      CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 100 + p_size / 10.0 END AS x, 30.5 AS y FROM part)"""


def _detail(spark, sf):
    c = F.col
    return table(spark, sf, "part").select(
        c("p_partkey").alias("part_id"),
        F.when(c("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("装"), "p_type")).alias("decoration"),
        F.when(c("p_partkey") % 4 == 0, 0).otherwise(1990 + c("p_size") % 30).alias("build_year"),
        (c("p_size") % 2).alias("bathrooms"),
        F.when(c("p_partkey") % 5 == 0, 0.0).otherwise(100 + c("p_size") / F.lit(10.0)).alias("lng"),
        F.lit(30.5).alias("lat"))


@query("enrich_fill_missing", "J7 P10 H8", on_listings(f"""
    WITH {_DETAIL_SQL}
    SELECT id_key, CASE WHEN lng = 0 AND x > 0 THEN x ELSE lng END AS lng, CASE WHEN lng = 0 AND x > 0 THEN y ELSE lat END AS lat,
      CASE WHEN decoration = '' AND deco <> '' THEN deco ELSE decoration END AS decoration,
      CASE WHEN build_year = 0 AND yr > 0 THEN yr ELSE build_year END AS build_year,
      CASE WHEN bathrooms = 0 AND ba > 0 THEN ba ELSE bathrooms END AS bathrooms,
      (lng = 0 AND x > 0)::int + (decoration = '' AND deco <> '')::int + (build_year = 0 AND yr > 0)::int
        + (bathrooms = 0 AND ba > 0)::int AS filled
    FROM listings l LEFT JOIN d ON l.part_id = d.part_id"""))
def enrich_fill_missing(spark, sf):
    rows = listings(spark, sf, "id_key", "part_id", "lng", "lat", "decoration", "build_year", "bathrooms")
    return en.fill_missing(rows, _detail(spark, sf), "part_id").drop("part_id")


@query("enrich_overwrite", "J8", on_listings(f"""
    WITH {_DETAIL_SQL}
    SELECT id_key, CASE WHEN x > 0 THEN x ELSE lng END AS lng, CASE WHEN x > 0 THEN y ELSE lat END AS lat,
      CASE WHEN deco <> '' THEN deco ELSE decoration END AS decoration, CASE WHEN yr > 0 THEN yr ELSE build_year END AS build_year,
      CASE WHEN ba > 0 THEN ba ELSE bathrooms END AS bathrooms,
      coalesce(x > 0 OR deco <> '' OR yr > 0 OR ba > 0, false)::int AS touched
    FROM listings l LEFT JOIN d ON l.part_id = d.part_id"""))
def enrich_overwrite(spark, sf):
    rows = listings(spark, sf, "id_key", "part_id", "lng", "lat", "decoration", "build_year", "bathrooms")
    done = en.overwrite_present(rows, _detail(spark, sf), "part_id").drop("part_id")
    return done.withColumn("touched", F.col("touched").cast("int"))


@query("complete_fields", "F17 F18 H8", on_listings("""
    SELECT id_key, CASE WHEN feed_unit_price = 0 THEN cast(format('{:.2f}', total_price * 10000.0 / area) AS double)
                        ELSE feed_unit_price END AS unit_price,
           CASE WHEN bathrooms <> 0 THEN bathrooms WHEN total_floors % 2 = 0 AND feed_rank > 0 THEN feed_rank
                WHEN rooms <= 2 THEN 1 ELSE 2 END AS bathrooms FROM listings"""))
def complete_fields(spark, sf):
    df = listings(spark, sf, "id_key", "feed_unit_price", "total_price", "area", "bathrooms", "total_floors",
                  "rooms", "feed_rank")
    layout = F.when((F.col("total_floors") % 2 == 0) & (F.col("feed_rank") > 0),
                    F.concat(F.lit("2室"), F.col("feed_rank").cast("string"), F.lit("卫"))).otherwise("2室1厅")
    rows = df.withColumn("layout", layout).withColumn("unit_price", F.col("feed_unit_price"))
    return en.complete(rows).select("id_key", "unit_price", "bathrooms")


@query("code_lookup", "J2 F19 F20 F22 F21 F23", on_listings("""
    SELECT id_key, CASE floor_type WHEN '低层' THEN 0 WHEN '高层' THEN 2 ELSE 1 END AS floor_code,
      CASE decoration WHEN '毛坯' THEN 0 WHEN '精装' THEN 2 WHEN '豪装' THEN 3 ELSE 1 END AS decoration_code,
      CASE WHEN orientation LIKE '%南%' THEN 3 WHEN orientation LIKE '%东%' THEN 1 ELSE 0 END AS orientation_code,
      CASE WHEN orientation = '东南' THEN 2 WHEN orientation LIKE '%南%' THEN 3 WHEN orientation LIKE '%东%' THEN 1 ELSE 0 END
        AS orientation_corrected,
      greatest(least(2026 - greatest(least(build_year, 2025), 1980), 50), 0) AS house_age,
      round(greatest(least(area / greatest(least(rooms + halls + bathrooms, 20), 1), 100), 5), 6) AS area_per_room
    FROM listings"""))
def code_lookup(spark, sf):
    df = listings(spark, sf, "id_key", "floor_type", "decoration", "orientation", "build_year", "area", "rooms",
                  "halls", "bathrooms")
    c = F.col
    return df.select(
        "id_key", housing.floor_code(c("floor_type")).alias("floor_code"),
        housing.decoration_code(c("decoration")).alias("decoration_code"),
        housing.orientation_code(c("orientation")).alias("orientation_code"),
        housing.orientation_code(c("orientation"), corrected=True).alias("orientation_corrected"),
        housing.house_age(housing.clip(c("build_year"), 1980, 2025), 2026).alias("house_age"),
        F.round(housing.area_per_room(c("area"), c("rooms"), c("halls"), c("bathrooms")), 6).alias("area_per_room"))


@query("unit_price_check", "F17 F21", on_listings("""
    SELECT id_key, cast(format('{:.2f}', total_price * 10000.0 / area) AS double) AS expected,
           greatest(least(total_floors, 40), 5) AS floors FROM listings"""))
def unit_price_check(spark, sf):
    df = listings(spark, sf, "id_key", "total_price", "area", "total_floors")
    df = df.withColumn("raw", F.col("total_price") * 10000.0 / F.col("area"))
    return df.select("id_key", round_half_even(F.col("raw"), 2).alias("expected"),
                     housing.clip(F.col("total_floors"), 5, 40).alias("floors"))
