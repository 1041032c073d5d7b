"""Listing-shaped views over the supplied tables.

The column definitions are plain SQL that Spark and the SQL twin both read.
``listings`` joins only the tables whose columns are asked for, so a statistic
over price and district never touches ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column -> (tables needed, expression)
LISTING_COLUMNS: dict[str, tuple[str, str]] = {
    "id_key": ("L", "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
                    "cast(l_partkey as string), cast(l_suppkey as string), "
                    "cast(cast(round(l_extendedprice * 100) as bigint) as string))"),
    "title": ("LP", "concat(p_name, ' ', cast(cast(floor(l_extendedprice / 250) as bigint) as string), '万')"),
    "district": ("LN", "n_name"),
    "community": ("LP", "p_brand"),
    "address": ("LC", "c_name"),
    "total_price": ("L", "l_extendedprice / 250"),
    "unit_price": ("L", "l_extendedprice / l_quantity"),
    "area": ("L", "l_quantity * 4"),
    "layout": ("LP", "concat(cast(l_linenumber as string), '室', cast(1 + p_size % 2 as string), '厅', "
                     "cast(p_size % 3 as string), '卫')"),
    "rooms": ("L", "l_linenumber"),
    "halls": ("LP", "1 + p_size % 2"),
    "bathrooms": ("LP", "p_size % 3"),
    "floor_type": ("L", "case l_returnflag when 'A' then '低层' when 'N' then '中层' else '高层' end"),
    "total_floors": ("LP", "p_size"),
    "decoration": ("LP", "case p_type when 'ECONOMY' then '毛坯' when 'STANDARD' then '简装' "
                         "when 'MEDIUM' then '精装' when 'LARGE' then '精装' when 'PROMO' then '豪装' else '' end"),
    "orientation": ("LO", "case substr(o_orderpriority, 1, 1) when '1' then '南' when '2' then '东南' "
                          "when '3' then '东' when '4' then '北' else '' end"),
    "build_year": ("LP", "case when p_size % 10 = 0 then 0 else 1975 + p_size end"),
    "lng": ("LC", "case when l_tax = 0 then cast(0 as double) else 106 + (c_custkey % 1000) / cast(1000 as double) end"),
    "lat": ("L", "case when l_tax = 0 then cast(0 as double) else 29 + (l_suppkey % 100) / cast(100 as double) end"),
    "source": ("LC", "lower(c_mktsegment)"),
    "status": ("LO", "case o_orderstatus when 'O' then 'on_sale' when 'F' then 'probably_sold' else 'offline' end"),
    "first_seen": ("LO", "o_orderdate"),
    "last_updated": ("L", "l_shipdate"),
    "part_id": ("L", "l_partkey"),
    "order_id": ("L", "l_orderkey"),
    "supplier_id": ("L", "l_suppkey"),
    # Feed class and file of a row, and its price as the damaged feeds carry it.
    "feed_rank": ("L", "cast(l_suppkey % 4 as int)"),
    "feed_file": ("LN", "concat(case l_suppkey % 4 when 0 then 'anjuke_m_' when 1 then 'anjuke_all_' "
                        "when 2 then 'anjuke_fast_' else 'lianjia_' end, lower(replace(n_name, ' ', '')), '.csv')"),
    "damaged_price": ("L", "case when l_partkey % 7 = 0 then l_extendedprice / 250 * 10000 "
                           "when l_partkey % 7 = 1 then l_extendedprice / 250 * 100000 else l_extendedprice / 250 end"),
    "feed_unit_price": ("L", "case when l_partkey % 5 = 0 then cast(0 as double) else l_extendedprice / l_quantity end"),
    "image_urls": ("L", "case when l_suppkey % 3 = 0 then '' when l_suppkey % 3 = 1 then "
                        "concat('[\"https://img.example.com/', cast(l_partkey as string), '.jpg\"]') "
                        "else concat('[\"/api/placeholder/', cast(l_partkey as string), '\"]') end"),
}

_CUSTOMER, _NATION, _PART, _ORDERS = "C", "N", "P", "O"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, *columns: str, deal: bool = False) -> DataFrame:
    """Listing view with the named columns (all when none is named).

    ``deal`` is for costly per-row work: the joined rows are dealt out by their
    key, at every size, so that work is even whatever the splits of the files
    and the skew of the joins before it.
    """
    names = columns or tuple(LISTING_COLUMNS)
    needs = set("".join(LISTING_COLUMNS[n][0] for n in names))
    df = table(spark, sf_dir, "lineitem")
    if needs & {_ORDERS, _CUSTOMER, _NATION}:
        orders = table(spark, sf_dir, "orders")
        if needs & {_CUSTOMER, _NATION}:
            customer = table(spark, sf_dir, "customer")
            if _NATION in needs:
                nation = table(spark, sf_dir, "nation")
                customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if _PART in needs:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if deal:
        df = df.repartition("l_orderkey", "l_linenumber")
    return df.select(*[F.expr(LISTING_COLUMNS[n][1]).alias(n) for n in names])


def dealt_listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return listings(spark, sf_dir, *columns, deal=True)


_LISTINGS_CTE = (
    "listings AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, (_, e) in LISTING_COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    + " JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"
)

# Crawl log: one row per event.
CRAWL_LOG_SQL = (
    "SELECT event_id AS id, event_type AS source, concat('d', cast(user_id % 7 as string)) AS district, "
    "cast(floor(value) as int) AS new_added, {k} AS updated, "
    "case when event_type = 'error' then 'failed' else 'success' end AS status, ts AS crawl_time FROM events"
)
_LOG_CTE = "crawl_log AS (" + CRAWL_LOG_SQL.format(
    k="cast(json_extract_string(props, '$.k') as int)") + ")"


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"),
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("district"),
        F.floor("value").cast("int").alias("new_added"),
        F.get_json_object("props", "$.k").cast("int").alias("updated"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").alias("crawl_time"))


def _with(cte: str, sql: str) -> str:
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {cte}, {sql[5:]}"
    return f"WITH {cte} {sql}"


def on_listings(sql: str) -> str:
    return _with(_LISTINGS_CTE, sql)


def on_log(sql: str) -> str:
    return _with(_LOG_CTE, sql)
