"""Schemas and fixed values of the listing data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Field layouts of the raw feeds and of the cleaned record.
RAW_FIELDS_A = [
    "id", "title", "total_price", "unit_price", "community", "district", "address",
    "lng", "lat", "layout", "rooms", "halls", "bathrooms", "area", "orientation",
    "decoration", "floor_desc", "floor_type", "total_floors", "build_year", "tags",
    "followers", "source", "source_id", "fingerprint", "image_url",
]
RAW_FIELDS_B = [f for f in RAW_FIELDS_A if f not in ("tags", "followers", "image_url")]
STANDARD_FIELDS = [
    "title", "total_price", "unit_price", "community", "district", "address", "lng", "lat",
    "layout", "rooms", "halls", "bathrooms", "area", "orientation", "decoration",
    "floor_desc", "floor_type", "total_floors", "build_year", "tags", "source",
    "fingerprint", "source_id",
]

# Column widths of the stored text fields.
TEXT_WIDTHS = {
    "title": 300, "district": 50, "community": 100, "address": 300, "layout": 20,
    "floor_desc": 50, "floor_type": 10, "orientation": 20, "decoration": 20,
    "source": 20, "source_id": 100,
}

# Source codes and listing states.
SOURCE_A, SOURCE_B, SOURCE_SYNTHETIC = "anjuke", "lianjia", "augmented"
ON_SALE, PROBABLY_SOLD = "on_sale", "probably_sold"

# Histogram edges and their labels.
TOTAL_PRICE_BINS = ([50, 80, 120, 200, 300],
                    ["50万以下", "50-80万", "80-120万", "120-200万", "200-300万", "300万以上"])
UNIT_PRICE_BINS = ([5000, 8000, 12000, 18000, 25000],
                   ["5000以下", "5000-8000", "8000-12000", "12000-18000", "18000-25000", "25000以上"])
AREA_BINS = ([60, 90, 120, 150], ["60㎡以下", "60-90㎡", "90-120㎡", "120-150㎡", "150㎡以上"])

# Ordinal codes of the feature table.
FLOOR_CODES = {"低层": 0, "中层": 1, "高层": 2}
DECORATION_CODES = {"毛坯": 0, "简装": 1, "精装": 2, "豪装": 3}

MODEL_FEATURES = [
    "area", "rooms", "halls", "bathrooms", "total_floors", "house_age", "floor_type_code",
    "decoration_code", "orientation_code", "avg_room_area", "district_encoded",
    "community_encoded",
]
CLUSTER_FEATURES = MODEL_FEATURES + ["unit_price", "total_price"]

# Feed district code -> district name, and the codes the main run covers.
DISTRICT_BY_CODE = {
    "yubei": "两江新区", "yuzhong": "渝中区", "nanana": "南岸区", "shapingba": "沙坪坝区",
    "jiulongpo": "九龙坡区", "banan": "巴南区", "beibei": "北碚区", "dadukou": "大渡口区",
    "bishanqu": "璧山区", "yongchuanqu": "永川区", "wanzhouqu": "万州区", "jiangjinqu": "江津区",
    "hechuanqu": "合川区", "tongliangqu": "铜梁区", "fulingqu": "涪陵区", "changshouqu": "长寿区",
    "rongchangqu": "荣昌区", "qijiangqu": "綦江区", "nanchuanqu": "南川区", "dazhuqu": "大足区",
    "tongnanqu": "潼南区", "kaizhoukuaixian": "开州区", "dainjiangxian": "垫江县",
    "liangpingxian": "梁平区", "wansheng": "万盛区", "fengjiexian": "奉节县",
    "yunyangxian": "云阳县", "zhongxian": "忠县", "wuxixian": "巫溪县", "qianjiangqu": "黔江区",
    "wulongxian": "武隆区", "cqwushanxian": "巫山县", "chengkouxian": "城口县",
    "pengshuimiaozutujiazuzhixian": "彭水县", "xiushantujiazumiaozuzhixian": "秀山县",
    "shizhutujiazuzhixian": "石柱县", "youyangtujiazumiaozuzhixian": "酉阳县",
    "fengduxian": "丰都县",
}
# The second source's district code -> district name.
DISTRICT_BY_CODE_B = {
    "liangjiangxinqu": "两江新区", "yuzhong": "渝中区", "nanan": "南岸区", "shapingba": "沙坪坝区",
    "jiulongpo": "九龙坡区", "dadukou": "大渡口区", "banan": "巴南区", "beibei": "北碚区",
    "jiangjing": "江津区", "kaizhouqu": "开州区", "rongchangqu": "荣昌区", "bishan": "璧山",
}
CORE_DISTRICT_CODES = [
    "yubei", "yuzhong", "nanana", "shapingba", "jiulongpo", "banan", "beibei", "dadukou",
    "bishanqu", "yongchuanqu", "wanzhouqu", "jiangjinqu", "hechuanqu", "fulingqu",
]

# District tiers and their page budgets.
DISTRICT_TIERS = [
    ("主城", 50, ["两江新区", "渝中区", "南岸区", "沙坪坝区", "九龙坡区", "巴南区", "北碚区",
                "大渡口区", "渝北区"]),
    ("近郊", 35, ["璧山区", "永川区", "万州区", "江津区", "合川区", "铜梁区", "涪陵区", "长寿区",
                "綦江区", "荣昌区"]),
]
OTHER_TIER = ("远郊", 20)

LISTING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("title", "district", "community", "address")],
    T.StructField("total_price", T.DecimalType(12, 2)),
    T.StructField("unit_price", T.DecimalType(10, 2)),
    T.StructField("area", T.DecimalType(8, 2)),
    T.StructField("layout", T.StringType()),
    *[T.StructField(n, T.IntegerType()) for n in ("rooms", "halls", "bathrooms")],
    *[T.StructField(n, T.StringType()) for n in ("floor_desc", "floor_type")],
    T.StructField("total_floors", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("orientation", "decoration")],
    T.StructField("build_year", T.IntegerType()),
    T.StructField("lng", T.DecimalType(10, 6)),
    T.StructField("lat", T.DecimalType(10, 6)),
    T.StructField("followers", T.IntegerType()),
    *[T.StructField(n, T.StringType())
      for n in ("source", "source_id", "fingerprint", "status", "image_urls")],
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_updated", T.TimestampType()),
])

CRAWL_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("houses_found", T.IntegerType()),
    T.StructField("new_added", T.IntegerType()),
    T.StructField("updated", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("crawl_time", T.TimestampType()),
])


def all_strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
