"""Feed parsing, price repair, normalisation, de-duplication and table sinks."""

from pyspark.sql import functions as F

from dwellframe.functions import housing, identity
from dwellframe.functions.numbers import digits_to_double, finite, to_double, to_int
from dwellframe.functions.text import blank_to_null, or_blank
from dwellframe.operators import dedupe
from dwellframe.operators import statistics as st
from dwellframe.plans.registry import query
from dwellframe.plans.views import crawl_log, dealt_listings as listings, on_listings, on_log, table
from dwellframe.schema import RAW_FIELDS_A, RAW_FIELDS_B
from dwellframe.session import compiled_methods, scratch_path
from dwellframe.sources import feeds, tables


def r(x, d):
    return f"cast(format('{{:.{d}f}}', {x}) AS double)"


INFO = ("concat(rooms, '室', halls, '厅', bathrooms, '卫|', cast(area AS int), '平米|', orientation, '|', "
        "decoration, '|', floor_type, '(共', total_floors, '层)|', build_year, '年建')")


@query("parse_info_text", "F5 F6 F7 F8 F9", on_listings("""
    SELECT id_key, concat(rooms, '室', halls, '厅', bathrooms, '卫') AS layout, rooms, halls, bathrooms, area,
           orientation, decoration, concat(floor_type, '(共', total_floors, '层)') AS floor_desc, floor_type,
           total_floors, build_year % 10000 AS build_year, cast(area * 10 AS double) AS digits FROM listings
    """.replace("build_year % 10000", "CASE WHEN build_year >= 1000 THEN build_year ELSE 0 END")))
def parse_info_text(spark, sf):
    df = listings(spark, sf, "id_key", "rooms", "halls", "bathrooms", "area", "orientation", "decoration",
                  "floor_type", "total_floors", "build_year")
    info = F.expr(INFO.replace("cast(area AS int)", "cast(cast(area AS int) AS string)"))
    parsed = df.select("id_key", housing.split_info(info).alias("info"), "area")
    fields = housing.info_struct(F.col("info"))
    digits = digits_to_double(F.concat(F.lit("约"), (F.col("area") * 10).cast("int").cast("string"), F.lit("万元")))
    return parsed.select("id_key", fields.alias("f"), digits.alias("digits")).select("id_key", "f.*", "digits")


@query("safe_casts", "F1 F2 F3 F24 F28", """
    WITH t AS (SELECT doc_id, text, trim(left(text, 12)) AS head, split_part(text, ' ', 1) AS w FROM documents)
    SELECT doc_id, coalesce(CASE WHEN regexp_full_match(trim(w), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
             THEN try_cast(trim(w) AS double) END, 0) AS number,
           cast(trunc(n_chars * 0.37) AS int) AS whole, left(text, 20) AS head20
    FROM (SELECT t.*, n_chars FROM t JOIN documents USING (doc_id))""")
def safe_casts(spark, sf):
    df = table(spark, sf, "documents")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    whole = to_int((F.col("n_chars") * F.lit(0.37)).cast("string"), 0)
    return df.select("doc_id", F.coalesce(finite(to_double(word)), F.lit(0.0)).alias("number"),
                     whole.alias("whole"), F.left("text", F.lit(20)).alias("head20"))


# Price repair. Every other order has a title without a price, so the division rules act too.
_FEED_TITLE = "CASE WHEN order_id % 2 = 0 THEN title ELSE concat(address, ' ', community) END"
_REPAIR_CTE = f"""
    feed AS (SELECT id_key, feed_file, feed_rank, {_FEED_TITLE} AS title, community, district,
        CASE WHEN feed_rank = 3 THEN 'lianjia' ELSE 'anjuke' END AS source, rooms, area, lng,
        damaged_price AS tp, feed_unit_price AS up FROM listings),
    t AS (SELECT *, try_cast(nullif(regexp_extract(title, '([0-9]+[.]?[0-9]*)\\s*[万Ww]', 1), '') AS double) AS tt,
        {r('tp / 1e5', 4)} AS d5, {r('tp / 1e4', 4)} AS d4, {r('tp * 10000 / area', 2)} AS ex FROM feed),
    u AS (SELECT *, CASE WHEN tp >= 1e7 THEN d5 ELSE d4 END AS p1, CASE WHEN tp >= 1e7 THEN d4 ELSE d5 END AS p2 FROM t),
    v AS (SELECT *, CASE WHEN feed_rank = 3 THEN 'kept' WHEN tp <= 0 THEN 'invalid'
          WHEN tp <= 1000 AND up > 0 AND (up > ex * 5 OR up < ex / 5) THEN 'unit' WHEN tp <= 1000 THEN 'kept'
          WHEN coalesce(tt BETWEEN 3 AND 3000, false) THEN 'title' WHEN p1 > 0 AND p1 <= 5000 THEN 'divided'
          ELSE 'divided_other' END AS repair_rule FROM u),
    w AS (SELECT *, CASE repair_rule WHEN 'title' THEN {r('tt', 2)} WHEN 'divided' THEN p1
          WHEN 'divided_other' THEN p2 ELSE tp END AS total_price FROM v),
    repaired AS (SELECT *, CASE repair_rule WHEN 'unit' THEN ex WHEN 'title' THEN {r('tt * 10000 / area', 2)}
          WHEN 'divided' THEN {r('p1 * 10000 / area', 2)} WHEN 'divided_other' THEN {r('p2 * 10000 / area', 2)}
          ELSE up END AS unit_price, abs(tp - total_price) > 1 AS price_fixed,
        concat('ajk_', left(md5(concat_ws('|', left(title, 60), community, district, format('{{:.1f}}', area),
               cast(rooms AS varchar), format('{{:.1f}}', total_price))), 16)) AS fp_hash,
        CASE WHEN source = 'lianjia' THEN concat('lj_', id_key) ELSE fp_hash END AS fingerprint,
        concat_ws('|', left(title, 80), community, district, source) AS cross_key FROM w)"""


def _feed(spark, sf):
    """Raw feed rows as the readers deliver them, with the row key as line order."""
    df = listings(spark, sf, "id_key", "feed_file", "feed_rank", "title", "address", "order_id", "community",
                  "district", "rooms", "area", "lng", "damaged_price", "feed_unit_price")
    return df.select(
        "id_key", "feed_file", "feed_rank", F.expr(_FEED_TITLE).alias("title"), "community", "district",
        F.when(F.col("feed_rank") == 3, "lianjia").otherwise("anjuke").alias("source"),
        F.col("id_key").alias("source_id"), "rooms", "area", "lng",
        F.col("damaged_price").alias("total_price"), F.col("feed_unit_price").alias("unit_price"))


def _repaired(spark, sf):
    return feeds.repair(_feed(spark, sf))


@query("price_repair", "F15 F16 F4", on_listings(f"""WITH {_REPAIR_CTE}
    SELECT id_key, total_price, unit_price, repair_rule, cast(price_fixed AS int) AS fixed, fingerprint FROM repaired"""))
def price_repair(spark, sf):
    return _repaired(spark, sf).select("id_key", "total_price", "unit_price", "repair_rule",
                                       F.col("price_fixed").cast("int").alias("fixed"), "fingerprint")


@query("repair_rules", "F15 A20", on_listings(f"""WITH {_REPAIR_CTE}
    SELECT feed_rank, repair_rule, count(*) AS n FROM repaired GROUP BY ALL"""))
def repair_rules(spark, sf):
    return _repaired(spark, sf).groupBy("feed_rank", "repair_rule").agg(F.count("*").alias("n"))


@query("dedupe_title", "W1", on_listings("""
    WITH f AS (SELECT id_key, feed_file, CASE WHEN part_id % 11 = 0 THEN '' ELSE title END AS title
               FROM listings WHERE feed_rank = 0)
    SELECT id_key, feed_file, title FROM f
    QUALIFY title = '' OR row_number() OVER (PARTITION BY feed_file, title ORDER BY id_key) = 1"""))
def dedupe_title(spark, sf):
    df = listings(spark, sf, "id_key", "feed_file", "title", "part_id", "feed_rank").where("feed_rank = 0")
    df = df.withColumn("title", F.when(F.col("part_id") % 11 == 0, "").otherwise(F.col("title")))
    return dedupe.unique_titles(df, ["id_key"]).select("id_key", "feed_file", "title")


_SURVIVORS = """
    m AS (SELECT * FROM repaired WHERE feed_rank = 0
          QUALIFY title = '' OR row_number() OVER (PARTITION BY feed_file, title ORDER BY id_key) = 1),
    o AS (SELECT * FROM repaired WHERE feed_rank > 0 AND cross_key NOT IN (SELECT cross_key FROM m)
          QUALIFY row_number() OVER (PARTITION BY cross_key ORDER BY feed_rank, id_key) = 1),
    s AS (SELECT * FROM m UNION ALL SELECT * FROM o),
    final AS (SELECT * FROM s QUALIFY fingerprint = '' OR
          row_number() OVER (PARTITION BY fingerprint ORDER BY feed_rank, id_key) = 1)"""


@query("dedupe_cross_file", "W2 J3", on_listings(f"""WITH {_REPAIR_CTE}, {_SURVIVORS}
    SELECT id_key, feed_rank, title FROM s"""))
def dedupe_cross_file(spark, sf):
    return dedupe.survivors(_repaired(spark, sf), ["id_key"]).select("id_key", "feed_rank", "title")


@query("dedupe_fingerprint", "W3 F4", on_listings(f"""WITH {_REPAIR_CTE}, {_SURVIVORS}
    SELECT id_key, fingerprint, total_price FROM final"""))
def dedupe_fingerprint(spark, sf):
    return dedupe.clean(_repaired(spark, sf), ["id_key"]).select("id_key", "fingerprint", "total_price")


@query("clean_stats", "A20 S10", on_listings(f"""WITH {_REPAIR_CTE}, {_SURVIVORS}
    SELECT (SELECT count(*) FROM repaired) AS total_read,
           (SELECT count(*) FROM repaired WHERE feed_rank = 0 AND price_fixed) AS price_fixed,
           (SELECT count(*) FROM repaired WHERE feed_rank > 0) - (SELECT count(*) FROM o) AS cross_file_dup,
           (SELECT count(*) FROM repaired WHERE feed_rank = 0) - (SELECT count(*) FROM m) AS intra_file_dup_title,
           (SELECT count(*) FROM final) AS final_count, (SELECT count(*) FROM s WHERE lng > 0) AS lng_ok,
           (SELECT count(*) FROM s) - (SELECT count(*) FROM final) AS fingerprint_dup"""))
def clean_stats(spark, sf):
    path = scratch_path(spark, "clean-stats")
    with compiled_methods(spark):
        tables.stats_json(dedupe.clean_metrics(_repaired(spark, sf), ["id_key"]), path)
    return spark.read.schema(", ".join(f"{m} bigint" for m in dedupe.METRICS)).json(path)


@query("clean_distribution", "A21 A20", on_listings(f"""WITH {_REPAIR_CTE}, {_SURVIVORS}
    SELECT source, count(*) AS rows, count(*) FILTER (total_price > 1 AND total_price < 5000) AS samples,
           round(min(total_price) FILTER (total_price > 1 AND total_price < 5000), 1) AS min_price,
           round(avg(total_price) FILTER (total_price > 1 AND total_price < 5000), 1) AS avg_price,
           round(max(total_price) FILTER (total_price > 1 AND total_price < 5000), 1) AS max_price
    FROM final GROUP BY source"""))
def clean_distribution(spark, sf):
    price = F.when((F.col("total_price") > 1) & (F.col("total_price") < 5000), F.col("total_price"))
    return dedupe.clean(_repaired(spark, sf), ["id_key"]).groupBy("source").agg(
        F.count("*").alias("rows"), F.count(price).alias("samples"),
        F.round(F.min(price), 1).alias("min_price"), F.round(F.avg(price), 1).alias("avg_price"),
        F.round(F.max(price), 1).alias("max_price"))


@query("dedupe_feed_key", "W4 F4", on_listings("""
    WITH f AS (SELECT id_key, CASE WHEN part_id % 13 = 0 THEN '' ELSE md5(concat_ws('|', community, district,
        format('{:.1f}', area), cast(rooms AS varchar), format('{:.1f}', total_price))) END AS fingerprint FROM listings)
    SELECT id_key, fingerprint FROM f WHERE fingerprint <> ''
    QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id_key) = 1"""))
def dedupe_feed_key(spark, sf):
    df = listings(spark, sf, "id_key", "part_id", "community", "district", "area", "rooms", "total_price")
    df = identity.with_feed_fingerprint(df).withColumn(
        "fingerprint", F.when(F.col("part_id") % 13 == 0, "").otherwise(F.col("fingerprint")))
    return dedupe.unique_fingerprints(df.select("id_key", "fingerprint"), ["id_key"], blanks="drop")


@query("fingerprint_presets", "F4", on_listings("""
    SELECT id_key, CASE WHEN source = 'machinery' THEN '' ELSE concat('lj_', id_key) END AS id_print,
           concat('aug_', left(md5(concat_ws('|', left(title, 60), community, district, format('{:.1f}', area),
             cast(rooms AS varchar), format('{:.2f}', total_price))), 16)) AS synthetic_print,
           md5(concat_ws('|', title, community, district)) AS stable_print FROM listings"""))
def fingerprint_presets(spark, sf):
    df = listings(spark, sf, "id_key", "source", "title", "community", "district", "area", "rooms", "total_price")
    c = F.col
    sid = F.when(c("source") == "machinery", "").otherwise(c("id_key"))
    return df.select(
        "id_key", identity.id_fingerprint(sid).alias("id_print"),
        identity.synthetic_fingerprint(c("title"), c("community"), c("district"), c("area"), c("rooms"),
                                       c("total_price")).alias("synthetic_print"),
        identity.stable_key(c("title"), c("community"), c("district")).alias("stable_print"))


@query("normalize_union", "S5 U1 U2 F3", on_listings("""
    SELECT id_key, 'anjuke' AS source, trim(decoration) AS decoration, floor_type, tags FROM
      (SELECT *, address AS tags FROM listings WHERE feed_rank <= 2)
    UNION ALL
    SELECT id_key, 'lianjia', trim(decoration), floor_type, '' FROM listings WHERE feed_rank = 3"""))
def normalize_union(spark, sf):
    df = listings(spark, sf, "id_key", "feed_file", "feed_rank", "decoration", "floor_type", "address")
    rich = df.where("feed_rank <= 2").withColumn("tags", F.col("address")).withColumn("source", F.lit(" "))
    lean = df.where("feed_rank = 3").withColumn("source", F.lit("lianjia"))
    both = feeds.union_feeds(rich.drop("address"), lean.drop("address"), default_source="anjuke")
    padded = both.withColumn("decoration", F.concat(F.lit(" "), F.col("decoration"), F.lit("  ")))
    rows = feeds.normalise(padded.drop("feed_rank"), carry=["id_key"])
    return rows.select("id_key", "source", "decoration", "floor_type", "tags")


@query("csv_feeds", "S1 S2 S3 S4 S9 U1", on_listings("""
    SELECT feed_rank, feed_file, district, count(*) AS rows, cast(sum(rooms) AS bigint) AS rooms,
           round(sum(area), 1) AS area, count(DISTINCT title) AS titles, count(DISTINCT id_key) AS ids,
           concat('s', feed_rank) AS file_source, count(*) FILTER (feed_rank < 3) AS tagged,
           replace(replace(split_part(feed_file, '_', 2), '.csv', ''), 'all', 'all') AS tag FROM
      (SELECT * FROM listings) GROUP BY ALL""").replace(
    "replace(replace(split_part(feed_file, '_', 2), '.csv', ''), 'all', 'all')",
    "regexp_replace(regexp_replace(feed_file, '[.]csv$', ''), '^(anjuke_m_|anjuke_fast_|anjuke_|lianjia_)', '')"))
def csv_feeds(spark, sf):
    path = scratch_path(spark, "feeds")
    df = listings(spark, sf, "id_key", "feed_file", "feed_rank", "title", "district", "area", "rooms", "total_price", "unit_price")
    df = df.withColumnsRenamed({"id_key": "id", "feed_rank": "rank"})
    df = df.withColumns({"source": F.concat(F.lit("s"), "rank"), "source_id": F.col("id"), "tags": F.lit("t")})
    second = F.col("feed_file").startswith("lianjia_")
    # Two layouts under one path: the second source has no tags, followers and image url.
    feeds.write_feed(df.where(~second), path, RAW_FIELDS_A, by_file=True, mark=True)
    feeds.write_feed(df.where(second), path, RAW_FIELDS_B, by_file=True, mode="append")
    raw = feeds.read_feed(spark, path, RAW_FIELDS_A, tolerant=True)
    rows = raw.withColumns({"feed_rank": feeds.feed_class(F.col("feed_file")),
                            "tag": feeds.district_from_name(F.col("feed_file"))})
    return rows.groupBy("feed_rank", "feed_file", "district", "tag").agg(
        F.count("*").alias("rows"), F.sum(to_int(F.col("rooms"), 0)).alias("rooms"),
        F.round(F.sum(to_double(F.col("area"), 0.0)), 1).alias("area"), F.countDistinct("title").alias("titles"),
        F.countDistinct("source_id").alias("ids"), F.max("source").alias("file_source"),
        F.count_if(F.col("tags") == "t").alias("tagged"))


@query("typed_nulls", "F1 F2 S5", on_listings("""
    SELECT district, count(*) AS rows, count(nullif(build_year, 0)) AS with_year, count(nullif(bathrooms, 0)) AS with_baths,
           count(CASE WHEN lng > 0 THEN 1 END) AS with_coords, count(nullif(decoration, '')) AS with_decoration,
           round(avg(nullif(build_year, 0)), 2) AS avg_year, round(avg(build_year), 2) AS avg_year_legacy
    FROM listings GROUP BY district"""))
def typed_nulls(spark, sf):
    df = listings(spark, sf, "district", "build_year", "bathrooms", "lng", "decoration")
    legacy = feeds.typed(df, legacy_zeros=True).select(F.col("build_year").alias("year_legacy"), F.struct(*df.columns).alias("r"))
    rows = feeds.typed(legacy.select("year_legacy", "r.*"))
    return rows.groupBy("district").agg(
        F.count("*").alias("rows"), F.count("build_year").alias("with_year"), F.count("bathrooms").alias("with_baths"),
        F.count("lng").alias("with_coords"), F.count("decoration").alias("with_decoration"),
        F.round(F.avg("build_year"), 2).alias("avg_year"), F.round(F.avg("year_legacy"), 2).alias("avg_year_legacy"))


@query("load_table", "S11 P8", on_listings("""
    WITH f AS (SELECT id_key, left(title, 300) AS title, left(address, 300) AS address, left(layout, 20) AS layout,
        total_price, concat(community, '|', title) AS fingerprint FROM listings)
    SELECT id_key, title, address, layout, round(total_price, 5) AS total_price, fingerprint FROM f
    WHERE f.total_price > 0 AND f.total_price <= 5000
    QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id_key) = 1"""))
def load_table(spark, sf):
    df = listings(spark, sf, "id_key", "title", "address", "layout", "total_price", "community")
    df = df.withColumn("fingerprint", F.concat_ws("|", "community", "title")).drop("community")
    path = scratch_path(spark, "houses")
    tables.load_table(df, path, ["id_key"])
    return spark.read.parquet(path).withColumn("total_price", F.round("total_price", 5))


@query("replace_slice", "S12 G7", on_listings("""
    SELECT source, count(*) AS rows, cast(sum(version) AS bigint) AS versions FROM (
      SELECT source, 1 AS version FROM listings WHERE source <> 'building'
      UNION ALL SELECT source, 2 FROM listings WHERE source = 'building' AND area > 100) GROUP BY source"""))
def replace_slice(spark, sf):
    path = scratch_path(spark, "slices")
    df = listings(spark, sf, "source", "id_key", "area")
    df.withColumn("version", F.lit(1)).write.partitionBy("source").parquet(path)
    tables.replace_slice(df.where("area > 100").withColumn("version", F.lit(2)), path, "source", "building")
    return spark.read.parquet(path).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum("version").alias("versions"))


@query("write_counts", "S8 S15", on_listings("""
    WITH s AS (SELECT area <= 40 AS small, status, status = 'on_sale' AND area > 100 AS hit, source = 'building' AS gone FROM listings)
    SELECT 'insert' AS statement, count(*) AS written, count(*) AS changed FROM s
    UNION ALL SELECT 'insert again', count(*), count(*) FROM s WHERE small
    UNION ALL SELECT 'update', count(*) + count(*) FILTER (small), count(*) FILTER (hit) + count(*) FILTER (hit AND small) FROM s
    UNION ALL SELECT 'update again', count(*) + count(*) FILTER (small), 0 FROM s
    UNION ALL SELECT 'delete', count(*) FILTER (NOT gone) + count(*) FILTER (small AND NOT gone),
                     count(*) FILTER (gone) + count(*) FILTER (small AND gone) FROM s
    UNION ALL SELECT 'stored', count(*) FILTER (NOT gone) + count(*) FILTER (small AND NOT gone),
                     count(*) FILTER (hit AND NOT gone) + count(*) FILTER (hit AND small AND NOT gone) FROM s"""))
def write_counts(spark, sf):
    """Rows written and changed by each statement, as its own write saw them, next to what is stored in the end."""
    df = listings(spark, sf, "id_key", "source", "status", "area")
    first, second, third, last = (scratch_path(spark, "statements") for _ in range(4))
    done = {"insert": tables.insert(df, first), "insert again": tables.insert(df.where("area <= 40"), first)}
    sets, where = {"status": F.lit("reserved")}, F.expr("status IN ('on_sale', 'reserved') AND area > 100")
    done["update"] = tables.update(spark.read.parquet(first), second, sets, where)
    done["update again"] = tables.update(spark.read.parquet(second), third, sets, where)
    done["delete"] = tables.delete(spark.read.parquet(third), last, F.col("source") == "building")
    rows = spark.createDataFrame([(k, v.written, v.changed) for k, v in done.items()], "statement string, written long, changed long")
    return rows.unionByName(spark.read.parquet(last).agg(
        F.lit("stored").alias("statement"), F.count("*").alias("written"), F.count_if(F.col("status") == "reserved").alias("changed")))


@query("result_store", "S13 S14", on_listings("""
    SELECT 'district' AS analysis_type, district AS name, count(*) AS n FROM listings GROUP BY district
    UNION ALL SELECT 'source', source, count(*) FROM listings GROUP BY source"""))
def result_store(spark, sf):
    path = scratch_path(spark, "results")
    df = listings(spark, sf, "district", "source")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    for kind in ("district", "source", "source"):  # storing a type again replaces it
        tables.store_result(df.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("n")), path, kind, now)
    parts = [tables.read_result(spark, path, k, "name string, n bigint").withColumn("analysis_type", F.lit(k))
             for k in ("district", "source")]
    return parts[0].unionByName(parts[1])


@query("latest_result", "S14 O8", on_log("""
    SELECT source, id, status, crawl_time FROM crawl_log
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY crawl_time DESC, id DESC) = 1"""))
def latest_result(spark, sf):
    return tables.latest_per_type(crawl_log(spark, sf), "source", "crawl_time", "id", "id", "status", "crawl_time")


@query("append_log", "S15 T3", on_log("""
    SELECT source, count(*) * 2 AS runs, cast(sum(new_added) * 2 AS bigint) AS new_added FROM crawl_log GROUP BY source"""))
def append_log(spark, sf):
    path = scratch_path(spark, "log")
    log = crawl_log(spark, sf).select("id", "source", "new_added")
    for _ in range(2):
        tables.append(log, path)
    return spark.read.parquet(path).groupBy("source").agg(
        F.count("*").alias("runs"), F.sum("new_added").alias("new_added"))


@query("merge_keyed", "S16 W4", """
    WITH old AS (SELECT cast(user_id AS varchar) AS id, event_id AS seq, value FROM events WHERE event_type <> 'view'
                 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
         new AS (SELECT cast(user_id AS varchar) AS id, event_id AS seq, value FROM events
                 WHERE event_type = 'view' AND user_id % 3 = 0
                 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)""")
def merge_keyed(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "value",
                         "event_type", "user_id")
    old = rows.where("event_type <> 'view'").select("id", "seq", "value")
    new = rows.where("event_type = 'view' AND user_id % 3 = 0").select("id", "seq", "value")
    return tables.merge_keyed(old, new, "id", ["seq"])


@query("pending_files", "U5 T7 S17", on_listings("""
    SELECT feed_file, count(*) AS rows FROM listings WHERE feed_file NOT IN
      (SELECT feed_file FROM listings WHERE total_price > 419.5) GROUP BY feed_file"""))
def pending_files(spark, sf):
    df = listings(spark, sf, "feed_file", "total_price")
    found = df.groupBy("feed_file").agg(F.count("*").alias("rows"))
    return tables.pending(found, df.where("total_price > 419.5"), "feed_file")


@query("progress_board", "J13 T7", """
    WITH d AS (SELECT n_nationkey % 25 AS k, n_name FROM nation),
         p AS (SELECT cast(user_id % 20 AS int) AS k, count(DISTINCT cast(ts AS date)) AS pages FROM events
               WHERE event_type = 'purchase' AND value > 180 GROUP BY 1),
         f AS (SELECT DISTINCT cast(user_id % 25 AS int) AS k FROM events WHERE value > 380)
    SELECT d.k, coalesce(p.pages, 0) AS pages_done,
           CASE WHEN f.k IS NOT NULL THEN 'done' WHEN p.pages > 0 THEN 'partial' ELSE 'not started' END AS progress
    FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN f ON d.k = f.k""")
def progress_board(spark, sf):
    events = table(spark, sf, "events")
    districts = table(spark, sf, "nation").select((F.col("n_nationkey") % 25).alias("k"))
    pages = (events.where("event_type = 'purchase' AND value > 180")
             .groupBy((F.col("user_id") % 20).cast("int").alias("k"))
             .agg(F.countDistinct(F.to_date("ts")).alias("pages_done")))
    finished = events.where("value > 380").select((F.col("user_id") % 25).cast("int").alias("k"))
    return tables.progress_board(districts, pages, finished, "k")


@query("progress_json", "T7", """
    SELECT user_id, count(DISTINCT cast(ts AS date)) AS done, count(DISTINCT cast(ts AS date)) AS crawled
    FROM events GROUP BY user_id""".replace("count(DISTINCT cast(ts AS date)) AS crawled",
    "CASE WHEN user_id % 2 = 0 THEN count(DISTINCT cast(ts AS date)) ELSE 0 END AS crawled"))
def progress_json(spark, sf):
    events = table(spark, sf, "events")
    # At most 31 distinct days per user: a bounded list whatever the number of events.
    days = events.groupBy("user_id").agg(F.collect_set(F.dayofmonth("ts")).alias("pages"))
    text = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(
        F.col("pages").alias("pages_done"), F.array().cast("array<int>").alias("pages_failed"),
        F.size("pages").alias("total_crawled")))).otherwise(F.to_json("pages"))
    parsed = tables.parse_progress(days.select("user_id", text.alias("progress")), "progress")
    return parsed.select("user_id", F.size("pages_done").alias("done"), F.col("total_crawled").alias("crawled"))


@query("feed_fields", "S5 F3", on_listings("""
    SELECT id_key, trim(concat(' ', title)) AS title, CASE WHEN decoration <> '' THEN decoration END AS decoration
    FROM listings"""))
def feed_fields(spark, sf):
    df = listings(spark, sf, "id_key", "title", "decoration")
    return df.select("id_key", or_blank(F.concat(F.lit(" "), "title")).alias("title"),
                     blank_to_null(F.col("decoration")).alias("decoration"))
