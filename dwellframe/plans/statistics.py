"""District, distribution and log statistics."""

from pyspark.sql import functions as F

from dwellframe.functions.text import compact_number
from dwellframe.operators import statistics as st
from dwellframe.operators.filters import priced
from dwellframe.plans.registry import query
from dwellframe.plans.views import crawl_log, listings, on_listings, on_log
from dwellframe.schema import AREA_BINS, TOTAL_PRICE_BINS, UNIT_PRICE_BINS

PRICED = "total_price > 0 AND total_price < 5000"


def _as_of():
    return F.lit("2024-01-31").cast("timestamp_ntz")



def _case(column, bins):
    edges, labels = bins
    arms = " ".join(f"WHEN {column} < {e} THEN '{v}'" for e, v in zip(edges, labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


TOTAL_CASE = _case("total_price", TOTAL_PRICE_BINS)
UNIT_CASE = _case("unit_price", UNIT_PRICE_BINS)
AREA_CASE = _case("area", AREA_BINS)


@query("district_top20", "A4 S6 O2", on_listings(f"""
    SELECT district, count(*) AS count, round(avg(unit_price), 2) AS avg_unit_price,
           round(avg(total_price), 2) AS avg_total_price
    FROM listings WHERE {PRICED} GROUP BY district ORDER BY count DESC, district LIMIT 20"""))
def district_top20(spark, sf):
    return st.district_top(listings(spark, sf, "district", "unit_price", "total_price"))


@query("overview", "A1", on_listings(f"""
    SELECT count(*) AS total_houses, round(avg(unit_price), 2) AS avg_unit_price,
           round(avg(total_price), 2) AS avg_total_price, round(max(unit_price), 2) AS max_unit_price,
           round(min(unit_price), 2) AS min_unit_price, count(DISTINCT district) AS district_count
    FROM listings WHERE {PRICED}"""))
def overview(spark, sf):
    return st.overview(listings(spark, sf, "district", "unit_price", "total_price"))


@query("latest_update", "A2", "SELECT max(l_shipdate) AS latest_last_updated FROM lineitem")
def latest_update(spark, sf):
    return st.latest(listings(spark, sf, "last_updated"), "last_updated")


@query("source_counts", "A3 A37", on_listings(
    "SELECT source, count(*) AS count FROM listings GROUP BY source"))
def source_counts(spark, sf):
    return st.counts_by(listings(spark, sf, "source"), "source")


@query("row_counts", "A37 T5", on_listings(
    "SELECT count(*) AS total, count(*) FILTER (status = 'on_sale') AS on_sale FROM listings"))
def row_counts(spark, sf):
    return listings(spark, sf, "status").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "on_sale").alias("on_sale"))


@query("district_detail", "A5", on_listings(f"""
    SELECT district, count(*) AS house_count, round(avg(unit_price), 2) AS avg_unit_price,
           round(avg(total_price), 2) AS avg_total_price, round(avg(area), 2) AS avg_area,
           round(max(total_price), 2) AS max_price, round(min(total_price), 2) AS min_price
    FROM listings WHERE {PRICED} GROUP BY district"""))
def district_detail(spark, sf):
    return st.district_detail(listings(spark, sf, "district", "unit_price", "total_price", "area"))


@query("category_dist", "A6", on_listings("""
    SELECT 'decoration' AS dimension, decoration AS name, count(*) AS count
    FROM listings WHERE decoration <> '' GROUP BY decoration
    UNION ALL
    SELECT 'floor_type', floor_type, count(*) FROM listings WHERE floor_type <> '' GROUP BY floor_type"""))
def category_dist(spark, sf):
    df = listings(spark, sf, "decoration", "floor_type")
    long = st.category_weights(df.withColumn("all", F.lit(1)), ["decoration", "floor_type"], "all")
    return long.where(F.col("value") != "").select(
        "dimension", F.col("value").alias("name"), F.col("weight").alias("count"))


@query("district_categories", "A6 A5", on_listings("""
    SELECT district, decoration, count(*) AS count FROM listings WHERE decoration <> ''
    GROUP BY district, decoration"""))
def district_categories(spark, sf):
    return st.category_counts(listings(spark, sf, "district", "decoration"), "decoration", "district")


@query("rooms_dist", "A7", on_listings(
    "SELECT rooms, count(*) AS count FROM listings WHERE rooms > 0 AND rooms <= 10 GROUP BY rooms"))
def rooms_dist(spark, sf):
    return st.room_counts(listings(spark, sf, "rooms"))


@query("district_rooms_dist", "A7", on_listings(
    "SELECT district, rooms, count(*) AS count FROM listings WHERE rooms > 0 GROUP BY district, rooms"))
def district_rooms_dist(spark, sf):
    return st.room_counts(listings(spark, sf, "district", "rooms"), "district", upper=None)


@query("avg_by_rooms", "A8", on_listings("""
    SELECT rooms, round(avg(unit_price), 0) AS avg_unit_price FROM listings
    WHERE rooms > 0 AND rooms <= 10 AND unit_price > 0 GROUP BY rooms"""))
def avg_by_rooms(spark, sf):
    return st.unit_price_by_rooms(listings(spark, sf, "rooms", "unit_price"))


@query("rooms_with_price", "J9", on_listings("""
    WITH c AS (SELECT rooms, count(*) AS count FROM listings WHERE rooms > 0 AND rooms <= 10 GROUP BY rooms),
         p AS (SELECT rooms, round(avg(unit_price), 0) AS avg_unit_price FROM listings
               WHERE rooms > 0 AND rooms <= 10 AND unit_price > 20000 GROUP BY rooms)
    SELECT c.rooms, c.count, coalesce(p.avg_unit_price, 0.0) AS avg_unit_price
    FROM c LEFT JOIN p ON c.rooms = p.rooms"""))
def rooms_with_price(spark, sf):
    df = listings(spark, sf, "rooms", "unit_price")
    prices = st.unit_price_by_rooms(df.where(F.col("unit_price") > 20000))
    return st.room_counts(df).join(prices, "rooms", "left").select(
        "rooms", "count", F.coalesce("avg_unit_price", F.lit(0.0)).alias("avg_unit_price"))


def _hist_sql(case, column, keep, by=""):
    lead = f"{by}, " if by else ""
    return on_listings(f"""
    SELECT {lead}{case} AS range, count(*) AS count, round(min({column}), 4) AS bin_min
    FROM listings WHERE {keep} GROUP BY {lead}{case}""")


@query("total_price_hist", "A9", _hist_sql(TOTAL_CASE, "total_price", PRICED))
def total_price_hist(spark, sf):
    return st.histogram(listings(spark, sf, "total_price"), "total_price", TOTAL_PRICE_BINS, priced())


@query("district_total_price_hist", "A9 A5", _hist_sql(TOTAL_CASE, "total_price", PRICED, "district"))
def district_total_price_hist(spark, sf):
    return st.histogram(listings(spark, sf, "district", "total_price"), "total_price",
                        TOTAL_PRICE_BINS, priced(), "district")


@query("unit_price_hist", "A10", _hist_sql(UNIT_CASE, "unit_price", "unit_price > 0 AND unit_price < 100000"))
def unit_price_hist(spark, sf):
    keep = (F.col("unit_price") > 0) & (F.col("unit_price") < 100000)
    return st.histogram(listings(spark, sf, "unit_price"), "unit_price", UNIT_PRICE_BINS, keep)


@query("area_hist", "A11", _hist_sql(AREA_CASE, "area", "area > 0"))
def area_hist(spark, sf):
    return st.histogram(listings(spark, sf, "area"), "area", AREA_BINS, F.col("area") > 0)


@query("district_area_hist", "A11 A5", _hist_sql(AREA_CASE, "area", "area > 0", "district"))
def district_area_hist(spark, sf):
    return st.histogram(listings(spark, sf, "district", "area"), "area", AREA_BINS, F.col("area") > 0, "district")


@query("top_communities", "A12 W5", on_listings("""
    SELECT district, community, count(*) AS count, round(avg(unit_price), 0) AS avg_price,
           cast(row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, community) AS int) AS rank
    FROM listings WHERE community <> '' GROUP BY district, community
    QUALIFY rank <= 10"""))
def top_communities(spark, sf):
    return st.top_communities(listings(spark, sf, "district", "community", "unit_price"))


@query("quick_stats", "A13", on_listings(f"""
    SELECT count(*) AS total_listings, cast(round(avg(unit_price), 0) AS bigint) AS avg_unit_price,
           round(avg(total_price), 1) AS avg_total_price, round(avg(area), 1) AS avg_area,
           cast(round(avg(build_year), 0) AS bigint) AS avg_build_year
    FROM listings WHERE {PRICED}"""))
def quick_stats(spark, sf):
    return st.quick_stats(listings(spark, sf, "unit_price", "total_price", "area", "build_year"))


@query("recent_24h", "A14 F38", on_listings("""
    SELECT count(*) FILTER (first_seen >= TIMESTAMP '2001-07-31') AS new_rows,
           count(*) FILTER (last_updated >= TIMESTAMP '2001-07-31' AND first_seen < TIMESTAMP '2001-07-31')
             AS updated_rows FROM listings"""))
def recent_24h(spark, sf):
    as_of = F.lit("2001-08-01").cast("timestamp_ntz")
    return st.recent_activity(listings(spark, sf, "first_seen", "last_updated"), as_of)


@query("daily_log_stats", "A15 F38", on_log("""
    SELECT cast(crawl_time AS date) AS date, cast(sum(new_added) AS bigint) AS total_new,
           cast(sum(updated) AS bigint) AS total_updated, count(DISTINCT source) AS sources
    FROM crawl_log WHERE crawl_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1"""))
def daily_log_stats(spark, sf):
    return st.daily_log(crawl_log(spark, sf), _as_of())


@query("source_log_stats", "A16", on_log("""
    SELECT source, count(*) AS total_runs, cast(sum(new_added) AS bigint) AS total_new,
           cast(sum(updated) AS bigint) AS total_updated, max(crawl_time) AS last_crawl
    FROM crawl_log WHERE crawl_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY source"""))
def source_log_stats(spark, sf):
    return st.source_log(crawl_log(spark, sf), _as_of())


@query("image_coverage", "A17", on_listings("""
    SELECT source, count(*) AS total, count(*) FILTER (image_urls IS NOT NULL AND image_urls <> '') AS has_images,
           round(100.0 * (count(*) FILTER (image_urls IS NOT NULL AND image_urls <> '')) / count(*), 1) AS pct
    FROM listings GROUP BY source"""))
def image_coverage(spark, sf):
    return st.image_coverage(listings(spark, sf, "source", "image_urls"))


@query("status_counts", "A18", on_listings(
    "SELECT source, status, count(*) AS count FROM listings GROUP BY source, status"))
def status_counts(spark, sf):
    return st.counts_by(listings(spark, sf, "source", "status"), "source", "status")


@query("on_sale_summary", "A18", on_listings("""
    SELECT count(*) AS on_sale, round(avg(total_price), 1) AS avg_total_price,
           round(avg(unit_price), 0) AS avg_unit_price FROM listings WHERE status = 'on_sale'"""))
def on_sale_summary(spark, sf):
    return st.on_sale_summary(listings(spark, sf, "status", "total_price", "unit_price"))


@query("source_summary", "A19", on_listings("""
    SELECT source, count(*) AS cnt, round(avg(unit_price), 0) AS avg_unit_price,
           round(avg(total_price), 1) AS avg_total_price, round(avg(area), 1) AS avg_area
    FROM listings GROUP BY source"""))
def source_summary(spark, sf):
    return st.source_summary(listings(spark, sf, "source", "unit_price", "total_price", "area"))


@query("store_summary", "A19 A37", on_listings("""
    SELECT count(*) AS total, count(DISTINCT district) AS districts, count(*) FILTER (lng > 0) AS with_coords,
           round(100.0 * (count(*) FILTER (lng > 0)) / count(*), 1) AS coord_pct,
           count(*) FILTER (status = 'on_sale') AS on_sale FROM listings"""))
def store_summary(spark, sf):
    return st.store_summary(listings(spark, sf, "district", "lng", "status"))


@query("price_span", "A21", on_listings("""
    SELECT count(*) AS samples, round(min(total_price), 1) AS min_price, round(avg(total_price), 1) AS avg_price,
           round(max(total_price), 1) AS max_price FROM listings WHERE total_price > 3 AND total_price < 5000"""))
def price_span(spark, sf):
    return st.price_span(listings(spark, sf, "total_price"), low=3)


@query("missing_profile", "A22", on_listings("""
    SELECT feed_file, count(*) AS rows, count(*) FILTER (lng = 0) AS missing_lng,
           count(*) FILTER (decoration = '') AS missing_decoration, count(*) FILTER (floor_type = '') AS missing_floor_desc,
           count(*) FILTER (build_year = 0) AS missing_build_year, count(*) FILTER (bathrooms = 0) AS missing_bathrooms,
           count(*) FILTER (id_key = '') AS missing_id FROM listings GROUP BY feed_file"""))
def missing_profile(spark, sf):
    df = listings(spark, sf, "feed_file", "lng", "decoration", "floor_type", "build_year", "bathrooms", "id_key")
    return st.missing_profile(
        df.withColumnsRenamed({"floor_type": "floor_desc", "id_key": "source_id"}), "feed_file")


@query("field_coverage", "A22 A21", on_listings("""
    SELECT count(*) AS rows, round(100.0 * (count(*) FILTER (lng > 0)) / count(*), 1) AS coord_pct,
           round(100.0 * (count(*) FILTER (decoration <> '')) / count(*), 1) AS decoration_pct,
           round(100.0 * (count(*) FILTER (build_year > 0)) / count(*), 1) AS year_pct FROM listings"""))
def field_coverage(spark, sf):
    return st.coverage(listings(spark, sf, "lng", "decoration", "build_year"))


@query("grouped_mean", "A23", on_listings("""
    SELECT community, round(avg(unit_price), 4) AS mean, count(unit_price) AS support FROM listings
    WHERE status = 'on_sale' GROUP BY community HAVING count(unit_price) >= 3"""))
def grouped_mean(spark, sf):
    df = listings(spark, sf, "community", "unit_price", "status").where(F.col("status") == "on_sale")
    return st.grouped_mean(df, "community", "unit_price", 3).withColumn("mean", F.round("mean", 4))


RANKING = """SELECT district, count(unit_price) AS count, round(avg(unit_price), 4) AS avg_unit_price,
    round(avg(total_price), 4) AS avg_total_price, round(avg(area), 4) AS avg_area FROM listings GROUP BY district"""


def _ranking(spark, sf):
    df = st.district_ranking(listings(spark, sf, "district", "unit_price", "total_price", "area"))
    return df.select("district", "count", *[F.round(c, 4).alias(c)
                                            for c in ("avg_unit_price", "avg_total_price", "avg_area")])


@query("district_ranking", "A25 O2 O9", on_listings(RANKING + " ORDER BY avg_unit_price DESC, district LIMIT 20"))
def district_ranking(spark, sf):
    return st.top_by(_ranking(spark, sf), 20, F.desc("avg_unit_price"), "district")


@query("district_ranking_by_count", "A25 O2 O9", on_listings(RANKING + " ORDER BY count DESC, district LIMIT 15"))
def district_ranking_by_count(spark, sf):
    return st.top_by(_ranking(spark, sf), 15, F.desc("count"), "district")


@query("district_ranking_map", "A25 F30", on_listings(f"""
    WITH r AS ({RANKING}), t AS (SELECT * FROM r ORDER BY avg_unit_price DESC, district LIMIT 20)
    SELECT 'avg_unit_price' AS measure, district, avg_unit_price AS value FROM t
    UNION ALL SELECT 'avg_total_price', district, avg_total_price FROM t
    UNION ALL SELECT 'avg_area', district, avg_area FROM t
    UNION ALL SELECT 'count', district, cast(count AS double) FROM t"""))
def district_ranking_map(spark, sf):
    top = st.top_by(_ranking(spark, sf), 20, F.desc("avg_unit_price"), "district")
    return top.withColumn("count", F.col("count").cast("double")).unpivot(
        "district", ["avg_unit_price", "avg_total_price", "avg_area", "count"], "measure", "value")


@query("share_of_total", "A33", on_listings("""
    WITH c AS (SELECT source, count(*) AS count FROM listings GROUP BY source)
    SELECT source, count, round(100.0 * count / sum(count) OVER (), 1) AS pct,
           cast(floor(100.0 * count / sum(count) OVER ()) AS bigint) AS pct_int FROM c"""))
def share_of_total(spark, sf):
    return st.shares(st.counts_by(listings(spark, sf, "source"), "source"))


@query("area_share", "A33 F33", on_listings(f"""
    WITH c AS (SELECT {AREA_CASE} AS range, count(*) AS count FROM listings WHERE area > 0 GROUP BY 1)
    SELECT range, count, round(100.0 * count / sum(count) OVER (), 1) AS pct,
           cast(floor(100.0 * count / sum(count) OVER ()) AS bigint) AS pct_int,
           CASE WHEN count >= 10000 THEN concat(format('{{:.1f}}', round(count / 10000.0, 1)), '万')
                ELSE cast(count AS varchar) END AS count_text FROM c"""))
def area_share(spark, sf):
    df = st.histogram(listings(spark, sf, "area"), "area", AREA_BINS, F.col("area") > 0).drop("bin_min")
    return st.shares(df).withColumn("count_text", compact_number(F.col("count")))


@query("page_total", "A34", on_listings(f"""
    SELECT count(*) AS total, cast(ceil(count(*) / 20.0) AS bigint) AS pages FROM listings
    WHERE {PRICED} AND district = 'NATION_7'"""))
def page_total(spark, sf):
    from dwellframe.operators.filters import search
    return st.pages_for(search(listings(spark, sf, "district", "total_price"), district="NATION_7"), 20)


@query("district_names", "A35 U6", on_listings("SELECT DISTINCT district FROM listings"))
def district_names(spark, sf):
    return listings(spark, sf, "district").distinct().orderBy("district")


@query("frame_summary", "A38", on_listings("""
    SELECT count(*) AS rows, round(min(total_price), 0) AS min_price, round(max(total_price), 0) AS max_price,
           round(avg(unit_price), 0) AS avg_unit_price, count(DISTINCT district) AS districts,
           count(DISTINCT community) AS communities FROM listings WHERE status = 'on_sale'"""))
def frame_summary(spark, sf):
    return st.frame_summary(listings(spark, sf, "status", "total_price", "unit_price", "district", "community")
                            .where(F.col("status") == "on_sale"))


@query("district_profile", "A28", on_listings("""
    SELECT district, count(*) AS count, round(avg(unit_price), 4) AS avg_unit_price,
      round(stddev_samp(unit_price), 4) AS std_unit_price, round(avg(total_price), 4) AS avg_total_price,
      round(stddev_samp(total_price), 4) AS std_total_price, round(avg(area), 4) AS avg_area,
      round(stddev_samp(area), 4) AS std_area, round(avg(total_floors), 4) AS avg_floors,
      round(avg(build_year), 4) AS avg_build_year, round(avg(lng) FILTER (lng > 0), 9) AS lng_mean,
      round(stddev_samp(lng) FILTER (lng > 0), 4) AS lng_std, round(avg(lat) FILTER (lat > 0), 9) AS lat_mean,
      round(stddev_samp(lat) FILTER (lat > 0), 4) AS lat_std
    FROM listings GROUP BY district HAVING count(*) >= 10"""))
def district_profile(spark, sf):
    df = st.district_profile(listings(spark, sf, "district", "unit_price", "total_price", "area",
                                      "total_floors", "build_year", "lng", "lat"))
    # Coordinates have three decimals, so their means can fall on a tie at few digits.
    return df.select("district", "count", *[F.round(c, 9 if c.endswith("_mean") else 4).alias(c) for c in df.columns[2:]])


@query("category_weights", "A28 W10", on_listings("""
    WITH w AS (
      SELECT district, 'rooms' AS dimension, cast(rooms AS varchar) AS value, count(*) AS weight FROM listings GROUP BY ALL
      UNION ALL SELECT district, 'orientation', orientation, count(*) FROM listings GROUP BY ALL
      UNION ALL SELECT district, 'decoration', decoration, count(*) FROM listings GROUP BY ALL)
    SELECT *, cast(sum(weight) OVER (PARTITION BY district, dimension ORDER BY encode(value)
                   ROWS UNBOUNDED PRECEDING) AS bigint) AS cumulative FROM w"""))
def category_weights(spark, sf):
    df = listings(spark, sf, "district", "rooms", "orientation", "decoration")
    return st.cumulative_weights(st.category_weights(df, ["rooms", "orientation", "decoration"]))
