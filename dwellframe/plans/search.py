"""Search, paging and nearest-listing queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.functions import housing, text
from dwellframe.functions.geo import WGS84_A, WGS84_B, WGS84_F
from dwellframe.functions.numbers import percent
from dwellframe.operators import filters as fl
from dwellframe.operators import statistics as st
from dwellframe.operators import topk
from dwellframe.operators.ranked import RankIndex
from dwellframe.plans.registry import query
from dwellframe.plans.views import crawl_log, listings, on_listings, on_log, table
from dwellframe.schema import CORE_DISTRICT_CODES, DISTRICT_BY_CODE, DISTRICT_BY_CODE_B, DISTRICT_TIERS, SOURCE_A, SOURCE_B
from dwellframe.session import scratch_path

PRICED = "total_price > 0 AND total_price < 5000"


@query("search_filters", "P1 P2 P4", on_listings(f"""
    SELECT id_key, district, round(total_price, 5) AS total_price, area, rooms, orientation FROM listings
    WHERE {PRICED} AND total_price >= 50 AND total_price <= 250 AND area >= 60 AND area <= 160 AND rooms = 3
      AND floor_type = '低层' AND orientation LIKE '%东%' AND lng > 0 AND lat > 0"""))
def search_filters(spark, sf):
    df = listings(spark, sf, "id_key", "district", "total_price", "area", "rooms", "floor_type",
                  "orientation", "lng", "lat")
    hits = fl.search(df, min_price=50, max_price=250, min_area=60, max_area=160, rooms=3,
                     floor_type="低层", orientation="东", district="", with_coords=True)
    return hits.select("id_key", "district", F.round("total_price", 5).alias("total_price"), "area",
                       "rooms", "orientation")


@query("search_images", "P1 P3", on_listings(f"""
    SELECT district, decoration, source, count(*) AS matches FROM listings
    WHERE {PRICED} AND image_urls IS NOT NULL AND image_urls <> '' AND image_urls LIKE '%http%'
      AND decoration = '精装' GROUP BY ALL"""))
def search_images(spark, sf):
    df = listings(spark, sf, "district", "decoration", "source", "total_price", "image_urls")
    return st.counts_by(fl.search(df, decoration="精装", with_images=True),
                        "district", "decoration", "source", name="matches")


@query("search_page", "O1 S8 A34", on_listings(f"""
    SELECT id_key, district, community, rooms, area FROM listings
    WHERE {PRICED} AND source = 'building' ORDER BY id_key LIMIT 20 OFFSET 40"""))
def search_page(spark, sf):
    df = listings(spark, sf, "id_key", "district", "community", "rooms", "area", "source", "total_price")
    return topk.page(fl.search(df, source="building"), "id_key", 3, 20).select(
        "id_key", "district", "community", "rooms", "area")


@query("search_page_keyset", "O1", on_listings(f"""
    SELECT id_key, rooms, area FROM listings WHERE {PRICED} AND id_key > '5' ORDER BY id_key LIMIT 20"""))
def search_page_keyset(spark, sf):
    df = fl.search(listings(spark, sf, "id_key", "rooms", "area", "total_price"))
    return topk.page_after(df, "id_key", "5", 20).select("id_key", "rooms", "area")


DEEP_PAGES = (1, 2, 100, 1000, 10000)


@query("deep_pages", "O1 A34", on_listings(f"""
    WITH r AS (SELECT id_key, rooms, area, row_number() OVER (ORDER BY id_key) - 1 AS ahead FROM listings WHERE {PRICED})
    SELECT cast(ahead // 20 + 1 AS int) AS page_no, id_key, rooms, area FROM r WHERE ahead // 20 + 1 IN {DEEP_PAGES}"""))
def deep_pages(spark, sf):
    """Early and deep pages from one rank index; pages beyond the last row are empty."""
    df = fl.search(listings(spark, sf, "id_key", "rooms", "area", "total_price")).select("id_key", "rooms", "area")
    index = RankIndex.build(df, scratch_path(spark, "ranks"), "id_key")
    pages = [index.page(no, 20).withColumn("page_no", F.lit(no)) for no in DEEP_PAGES]
    return reduce(DataFrame.unionByName, pages)


@query("point_lookup", "P5 S8", "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey = 42")
def point_lookup(spark, sf):
    return topk.by_id(table(spark, sf, "part"), "p_partkey", 42).select(
        "p_partkey", "p_name", "p_brand", "p_size")


@query("parameter_query", "S8 S7", on_listings("""
    SELECT district, count(*) AS n, round(avg(area), 2) AS avg_area FROM listings
    WHERE source IN ('building', 'machinery') AND total_price > 100 GROUP BY district"""))
def parameter_query(spark, sf):
    return spark.sql(
        "SELECT district, count(*) AS n, round(avg(area), 2) AS avg_area FROM {rows} "
        "WHERE array_contains(:sources, source) AND total_price > :floor GROUP BY district",
        args={"sources": ["building", "machinery"], "floor": 100},
        rows=listings(spark, sf, "district", "area", "source", "total_price"))


@query("area_presets", "P15", on_listings(f"""
    WITH presets(preset, lo, hi) AS (VALUES ('不限', -1.0, 1e9), ('50m²以下', 0, 50), ('50-70m²', 50, 70),
        ('70-90m²', 70, 90), ('90-120m²', 90, 120), ('120-150m²', 120, 150), ('150-200m²', 150, 200),
        ('200m²以上', 200, 1e9))
    SELECT preset, count(*) AS matches FROM listings JOIN presets ON area >= lo AND area <= hi
    WHERE {PRICED} GROUP BY preset"""))
def area_presets(spark, sf):
    return fl.preset_counts(listings(spark, sf, "area", "total_price"))


@query("preset_search", "P15 P1", on_listings(f"""
    SELECT rooms, count(*) AS n, round(avg(unit_price), 2) AS avg_unit_price FROM listings
    WHERE {PRICED} AND rooms = 5 AND area >= 90 AND area <= 120 AND decoration = '精装' GROUP BY rooms"""))
def preset_search(spark, sf):
    rooms = dict(fl.ROOM_PRESETS)["五室及以上"]
    _, low, high = next(p for p in fl.AREA_PRESETS if p[0] == "90-120m²")
    arguments = fl.preset_arguments(district=fl.ANY, decoration="精装", orientation=None, rooms=rooms)
    df = listings(spark, sf, "rooms", "area", "decoration", "unit_price", "total_price")
    return (fl.search(df, min_area=low, max_area=high, **arguments).groupBy("rooms")
            .agg(F.count("*").alias("n"), F.round(F.avg("unit_price"), 2).alias("avg_unit_price")))


@query("validity_filter", "P6 P7 P8", on_listings(f"""
    SELECT count(*) FILTER ({PRICED} AND area > 0 AND area < 500 AND rooms > 0 AND rooms <= 10
                            AND status = 'on_sale') AS analysable,
           count(*) FILTER (total_price > 5 AND total_price < 3000 AND unit_price > 500 AND unit_price < 100000
                            AND area >= 15 AND area <= 400) AS within_trim,
           count(*) FILTER (total_price > 0 AND total_price <= 5000 AND id_key <> '') AS loadable FROM listings"""))
def validity_filter(spark, sf):
    df = listings(spark, sf, "total_price", "unit_price", "area", "rooms", "status", "id_key")
    return df.withColumnRenamed("id_key", "fingerprint").agg(
        F.count_if(fl.valid_for_analysis()).alias("analysable"),
        F.count_if(fl.within_trim()).alias("within_trim"), F.count_if(fl.loadable()).alias("loadable"))


@query("pending_images", "P9", on_listings("""
    SELECT id_key, source FROM listings WHERE source = 'furniture' AND (image_urls IS NULL OR image_urls = '')
    ORDER BY id_key LIMIT 50"""))
def pending_images(spark, sf):
    return fl.pending_images(listings(spark, sf, "id_key", "source", "image_urls"), "furniture", 50,
                             "id_key").select("id_key", "source")


@query("needs_enrichment", "P10", on_listings("""
    SELECT feed_file, count(*) FILTER (lng = 0 OR decoration = '' OR build_year = 0 OR bathrooms = 0) AS list_fields,
           count(*) FILTER (lng = 0 OR decoration = '' OR build_year = 0 OR bathrooms = 0 OR orientation = '')
             AS with_floor FROM listings GROUP BY feed_file"""))
def needs_enrichment(spark, sf):
    df = listings(spark, sf, "feed_file", "lng", "decoration", "build_year", "bathrooms", "orientation")
    df = df.withColumnRenamed("orientation", "floor_desc")
    return df.groupBy("feed_file").agg(
        F.count_if(fl.needs_enrichment()).alias("list_fields"),
        F.count_if(fl.needs_enrichment(with_floor=True)).alias("with_floor"))


@query("parsed_listings", "P11", """
    SELECT lang, count(*) AS n, count(*) FILTER (trim(text) <> '' AND n_chars > 500) AS valid
    FROM documents GROUP BY lang""")
def parsed_listings(spark, sf):
    df = table(spark, sf, "documents").select(
        "lang", F.col("text").alias("title"),
        F.greatest(F.col("n_chars") - 500, F.lit(0)).alias("total_price"))
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fl.parsed_listing()).alias("valid"))


@query("districts_outside_core", "P12 U3", """
    SELECT n_name, n_nationkey FROM nation
    WHERE n_name NOT IN (SELECT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey
                         WHERE c_acctbal > 9900)""")
def districts_outside_core(spark, sf):
    nation = table(spark, sf, "nation").select("n_name", "n_nationkey")
    core = (table(spark, sf, "customer").where(F.col("c_acctbal") > 9900)
            .select(F.col("c_nationkey").alias("n_nationkey")).distinct())
    return fl.district_subset(nation, core, "n_nationkey")


@query("map_points", "P13 P16", on_listings("""
    SELECT id_key, lng, lat, unit_price FROM listings
    WHERE district = 'NATION_11' AND lng IS NOT NULL AND isfinite(lng) AND isfinite(lat)
    ORDER BY id_key LIMIT 500"""))
def map_points(spark, sf):
    df = listings(spark, sf, "id_key", "lng", "lat", "unit_price", "district")
    return topk.map_points(df, "NATION_11", 500, "id_key").select(
        "id_key", "lng", "lat", "unit_price")


_METRES = """2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 29.5) / 2), 2)
    + cos(radians(29.5)) * cos(radians(lat)) * pow(sin(radians(lng - 106.5) / 2), 2))))"""


@query("nearest_topk", "O5 P14 F31 F32", on_listings(f"""
    WITH d AS (SELECT id_key, district, {_METRES} AS m FROM listings WHERE lng > 0 AND lat > 0)
    SELECT id_key, district, round(m, 3) AS distance_m,
           CASE WHEN m < 1000 THEN concat(cast(cast(floor(m) AS int) AS varchar), 'm')
                ELSE concat(format('{{:.1f}}', m / 1000), 'km') END AS distance_text
    FROM d WHERE m <= 5000 ORDER BY m, id_key LIMIT 50"""))
def nearest_topk(spark, sf):
    df = listings(spark, sf, "id_key", "district", "lat", "lng")
    return topk.nearest(df, 29.5, 106.5, 50, max_km=5, tie="id_key").select(
        "id_key", "district", F.round("distance_m", 3).alias("distance_m"), "distance_text")


def _ellipsoid_sql(steps: int = 8) -> str:
    """Vincenty's steps one after the other; eight settle every pair of points in one province."""
    sql = f"""WITH i0 AS (
      SELECT id_key, district, radians(lng - 106.5) AS l, radians(lng - 106.5) AS lam, sin(atan({1 - WGS84_F!r} * tan(radians(29.5)))) AS s1,
             cos(atan({1 - WGS84_F!r} * tan(radians(29.5)))) AS c1, sin(atan({1 - WGS84_F!r} * tan(radians(lat)))) AS s2,
             cos(atan({1 - WGS84_F!r} * tan(radians(lat)))) AS c2 FROM listings WHERE lng > 0 AND lat > 0)"""
    for i in range(steps + 1):
        sql += f""",
    a{i} AS (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM i{i}),
    b{i} AS (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM a{i}),
    c{i} AS (SELECT *, 1 - sa * sa AS a, CASE WHEN 1 - sa * sa > 0 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS m,
                    {WGS84_F!r} / 16 * (1 - sa * sa) * (4 + {WGS84_F!r} * (4 - 3 * (1 - sa * sa))) AS c FROM b{i}),
    i{i + 1} AS (SELECT id_key, district, l, s1, c1, s2, c2,
                        l + (1 - c) * {WGS84_F!r} * sa * (sigma + c * ss * (m + c * cs * (2 * m * m - 1))) AS lam FROM c{i})"""
    u = f"(a * {(WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2!r})"
    return sql + f""",
    e AS (SELECT *, 1 + {u} / 16384 * (4096 + {u} * ({u} * (320 - 175 * {u}) - 768)) AS ea,
                 {u} / 1024 * (256 + {u} * ({u} * (74 - 47 * {u}) - 128)) AS eb FROM c{steps}),
    d AS (SELECT id_key, district, {WGS84_B!r} * ea * (sigma - eb * ss * (m + eb / 4 * (cs * (2 * m * m - 1)
                 - eb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) AS metres FROM e)
    SELECT id_key, district, round(metres, 3) AS distance_m,
           CASE WHEN metres < 1000 THEN concat(cast(cast(floor(metres) AS int) AS varchar), 'm')
                ELSE concat(format('{{:.1f}}', metres / 1000), 'km') END AS distance_text
    FROM d WHERE metres <= 5000 ORDER BY metres, id_key LIMIT 50"""


@query("nearest_ellipsoid", "O5 P14 F31 F32", on_listings(_ellipsoid_sql()))
def nearest_ellipsoid(spark, sf):
    df = listings(spark, sf, "id_key", "district", "lat", "lng")
    return topk.nearest(df, 29.5, 106.5, 50, max_km=5, tie="id_key", ellipsoid=True).select(
        "id_key", "district", F.round("distance_m", 3).alias("distance_m"), "distance_text")


@query("recommended_topk", "O6", on_listings(f"""
    SELECT id_key, district, round(unit_price, 4) AS unit_price FROM listings WHERE {PRICED}
    ORDER BY listings.unit_price DESC, id_key LIMIT 20"""))
def recommended_topk(spark, sf):
    df = fl.search(listings(spark, sf, "id_key", "district", "unit_price", "total_price"))
    return topk.recommended(df, 20, "id_key").select(
        "id_key", "district", F.round("unit_price", 4).alias("unit_price"))


@query("recommended_first_page", "O6", on_listings(f"""
    WITH p AS (SELECT id_key, unit_price FROM listings WHERE {PRICED} ORDER BY id_key LIMIT 20)
    SELECT id_key, round(unit_price, 4) AS unit_price FROM p ORDER BY p.unit_price DESC, id_key LIMIT 6"""))
def recommended_first_page(spark, sf):
    df = fl.search(listings(spark, sf, "id_key", "unit_price", "total_price"))
    return topk.recommended(df, 6, "id_key", first_page=20).select(
        "id_key", F.round("unit_price", 4).alias("unit_price"))


@query("log_history", "O7", on_log("""
    SELECT id, source, district, new_added, updated, status, crawl_time FROM crawl_log
    WHERE source = 'purchase' ORDER BY crawl_time DESC, id DESC LIMIT 20"""))
def log_history(spark, sf):
    return topk.log_history(crawl_log(spark, sf), 20, "purchase")


@query("latest_log", "O8", on_log("""
    SELECT 'all' AS scope, id, source, status, crawl_time FROM
      (SELECT * FROM crawl_log ORDER BY crawl_time DESC, id DESC LIMIT 1)
    UNION ALL
    SELECT 'click', id, source, status, crawl_time FROM
      (SELECT * FROM crawl_log WHERE source = 'click' ORDER BY crawl_time DESC, id DESC LIMIT 5)"""))
def latest_log(spark, sf):
    log = crawl_log(spark, sf).select("id", "source", "status", "crawl_time")
    newest = topk.log_history(log, 1).withColumn("scope", F.lit("all"))
    return newest.unionByName(topk.log_history(log, 5, "click").withColumn("scope", F.lit("click")))


@query("hash_sample", "G8", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       cast(round(l_extendedprice * 100) AS bigint)) AS k FROM lineitem)
    ORDER BY md5(concat('42|', k)), k LIMIT 500""")
def hash_sample(spark, sf):
    df = listings(spark, sf, "id_key", "order_id", "rooms", "part_id")
    return topk.sample_by_hash(df, "id_key", 500).select(
        F.col("order_id").alias("l_orderkey"), F.col("rooms").alias("l_linenumber"),
        F.col("part_id").alias("l_partkey"))


@query("price_tiers", "F34", on_listings("""
    SELECT CASE WHEN unit_price <= 0 THEN '#999' WHEN unit_price < 10000 THEN '#4CAF50'
                WHEN unit_price < 20000 THEN '#8BC34A' WHEN unit_price < 30000 THEN '#FFEB3B'
                WHEN unit_price < 50000 THEN '#FF9800' ELSE '#F44336' END AS colour,
           count(*) AS n, round(100.0 * (count(*) FILTER (area >= 120)) / count(*), 1) AS large_pct
    FROM listings GROUP BY 1"""))
def price_tiers(spark, sf):
    df = listings(spark, sf, "unit_price", "area")
    return df.groupBy(housing.price_colour(F.col("unit_price")).alias("colour")).agg(
        F.count("*").alias("n"),
        percent(F.count_if(F.col("area") >= 120), F.count("*")).alias("large_pct"))


@query("display_texts", "F33 F36", on_listings("""
    SELECT id_key, CASE WHEN rooms % 2 = 0 THEN layout ELSE concat(rooms, '室', halls, '厅', bathrooms, '卫') END
             AS layout_text,
           CASE WHEN total_floors % 4 = 0 THEN community ELSE title END AS title_text,
           CASE WHEN decoration <> '' THEN decoration END AS tag,
           CASE WHEN unit_price >= 10000 THEN concat(format('{:.1f}', round(unit_price / 10000, 1)), '万')
                ELSE format('{:.0f}', round(unit_price, 0)) END AS price_text FROM listings"""))
def display_texts(spark, sf):
    df = listings(spark, sf, "id_key", "layout", "rooms", "halls", "bathrooms", "title", "community",
                  "decoration", "unit_price", "total_floors")
    layout = F.when(F.col("rooms") % 2 == 0, F.col("layout")).otherwise("")
    title = F.when(F.col("total_floors") % 4 == 0, "").otherwise(F.col("title"))
    return df.select(
        "id_key",
        text.layout_text(layout, F.col("rooms"), F.col("halls"), F.col("bathrooms")).alias("layout_text"),
        text.title_text(title, F.col("community")).alias("title_text"),
        text.tag_text(F.col("decoration")).alias("tag"),
        text.compact_number(F.col("unit_price")).alias("price_text"))


@query("image_lists", "F29 O10", on_listings("""
    SELECT id_key, CASE WHEN image_urls = '' THEN 0 ELSE 1 END AS images,
           CASE WHEN image_urls = '' THEN NULL ELSE json_extract_string(image_urls, '$[0]') END AS first_image
    FROM listings"""))
def image_lists(spark, sf):
    df = listings(spark, sf, "id_key", "image_urls")
    urls = F.slice(text.parse_string_list(F.col("image_urls")), 1, 6)
    return df.select("id_key", F.size(urls).alias("images"), F.try_element_at(urls, F.lit(1)).alias("first_image"))


_TIER_SQL = " ".join(
    "WHEN name IN ({}) THEN '{}'".format(", ".join(f"'{n}'" for n in names), label)
    for label, _, names in DISTRICT_TIERS)
_CODES_SQL = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(DISTRICT_BY_CODE.items()))


_CODES_B_SQL = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(DISTRICT_BY_CODE_B.items()))


@query("district_codes", "J11", f"""
    WITH a(idx, code, name) AS (VALUES {_CODES_SQL}), b(idx, code, name) AS (VALUES {_CODES_B_SQL}),
      d AS (SELECT 'anjuke' AS source, code, name FROM a UNION ALL SELECT 'lianjia', code, name FROM b),
      f AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'anjuke' ELSE 'lianjia' END AS source,
                   CASE WHEN c_custkey % 2 = 0 THEN (SELECT code FROM a WHERE idx = c_custkey % 38)
                        ELSE coalesce((SELECT code FROM b WHERE idx = c_custkey % 13), 'unknown') END AS code FROM customer)
    SELECT f.source, f.code, coalesce(name, f.code) AS name, count(*) AS rows
    FROM f LEFT JOIN d ON d.source = f.source AND d.code = f.code GROUP BY ALL""")
def district_codes(spark, sf):
    """District names of feed rows by source and code; a code without a name stands for itself."""
    first, second = list(DISTRICT_BY_CODE), list(DISTRICT_BY_CODE_B)
    at = F.col("c_custkey") % 2 == 0
    feed = table(spark, sf, "customer").select(
        F.when(at, SOURCE_A).otherwise(SOURCE_B).alias("source"),
        F.when(at, F.get(F.array(*map(F.lit, first)), (F.col("c_custkey") % 38).cast("int"))).otherwise(
            F.coalesce(F.get(F.array(*map(F.lit, second)), (F.col("c_custkey") % 13).cast("int")), F.lit("unknown"))).alias("code"))
    return housing.with_district_name(feed).groupBy("source", "code", "name").agg(F.count("*").alias("rows"))


@query("district_directory", "J11 F39 P12", f"""
    WITH d(idx, code, name) AS (VALUES {_CODES_SQL}),
         c AS (SELECT c_custkey % 38 AS idx, count(*) AS customers FROM customer GROUP BY 1)
    SELECT code, name, customers, CASE {_TIER_SQL} ELSE '远郊' END AS tier,
           CASE WHEN code IN ({", ".join(f"'{c}'" for c in CORE_DISTRICT_CODES)}) THEN 1 ELSE 0 END AS core
    FROM d JOIN c ON d.idx = c.idx""")
def district_directory(spark, sf):
    # The directory is a fixed list of 38 rows, so broadcasting it is always safe.
    directory = spark.createDataFrame(
        [(i, c, n) for i, (c, n) in enumerate(DISTRICT_BY_CODE.items())], "idx int, code string, name string")
    customers = (table(spark, sf, "customer").groupBy((F.col("c_custkey") % 38).cast("int").alias("idx"))
                 .agg(F.count("*").alias("customers")))
    return customers.join(F.broadcast(directory), "idx").select(
        "code", "name", "customers", housing.district_tier(F.col("name")).tier.alias("tier"),
        F.col("code").isin(CORE_DISTRICT_CODES).cast("int").alias("core"))
