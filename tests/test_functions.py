"""Scalar functions on small hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from dwellframe.functions import geo, housing, identity, markup, text
from dwellframe.functions.numbers import digits_to_double, fixed_text, round_half_even, to_double, to_int


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_equals_python(spark, digits):
    rng = random.Random(digits)
    xs = [0.25, 0.35, 0.05, 2.675, 1.005, 0.5, 1.5, 2.5, 0.0] + [rng.uniform(0, 5000) for _ in range(2000)]
    xs += [rng.randint(0, 100000) / 8 for _ in range(500)] + [rng.randint(0, 10**7) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", round_half_even(F.col("x"), digits).alias("r"), fixed_text(F.col("x"), digits).alias("t")).collect()
    assert all(r.r == round(r.x, digits) for r in rows)
    if digits:
        assert all(r.t == f"{r.x:.{digits}f}" for r in rows)


@pytest.mark.parametrize("value,number,whole", [
    ("", None, None), ("3.7", 3.7, 3), (" 12 ", 12.0, 12), ("1e3", 1000.0, 1000), ("abc", None, None),
    ("12d", None, None), ("-5.9", -5.9, -5), (".5", 0.5, 0)])
def test_safe_numbers(spark, value, number, whole):
    r = one(spark, a=to_double(F.lit(value)), b=to_int(F.lit(value)))
    assert (r.a, r.b) == (number, whole)


def test_digits(spark):
    r = one(spark, a=digits_to_double(F.lit("约120.5万")), b=digits_to_double(F.lit("暂无")), c=digits_to_double(F.lit("1.2.3")))
    assert (r.a, r.b, r.c) == (120.5, None, None)


def test_info_line(spark):
    line = "3室2厅|122.25平米|南|精装|高楼层(共18层)|2005年建"
    df = spark.createDataFrame([(line,)], "s string").withColumn("p", housing.split_info(F.col("s")))
    r = df.select(housing.info_struct(F.col("p")).alias("f")).first().f
    assert (r.layout, r.rooms, r.halls, r.bathrooms, r.area) == ("3室2厅", 3, 2, 0, 122.25)
    # The list pattern does not know the long storey spelling.
    assert (r.orientation, r.decoration, r.floor_type, r.total_floors, r.build_year) == ("南", "精装", "", 18, 2005)


def test_floor_spellings(spark):
    r = one(spark, a=housing.floor_type(F.lit("高楼层(共18层)"), wide=True),
            b=housing.floor_type(F.lit("高楼层(共18层)"), normalise=True), c=housing.floor_type(F.lit("中层")))
    assert (r.a, r.b, r.c) == ("高楼层", "高层", "中层")


def test_keywords(spark):
    s = F.lit("126万,3室2厅1卫,91.77平米,13730元/平米,2017年,北,精装修")
    r = spark.range(1).select(housing.keywords_struct(s).alias("k")).first().k
    assert (r.bathrooms, r.unit_price, r.build_year, r.decoration) == (1, 13730.0, 2017, "精装修")


def test_coordinates(spark):
    r = spark.range(1).select(housing.coordinates(F.lit("province=x;coord=106.52,29.54")).alias("a"),
                              housing.coordinates(F.lit('"longitude": 106.1,\n"latitude": 29.2')).alias("b"),
                              housing.coordinates(F.lit("none")).alias("c")).first()
    assert (tuple(r.a), tuple(r.b), tuple(r.c)) == ((106.52, 29.54), (106.1, 29.2), (None, None))


REPAIRS = [  # total, unit, title, total out, unit out, rule (area 100)
    (0.0, 5.0, "", 0.0, 5.0, "invalid"), (80.0, 8000.0, "", 80.0, 8000.0, "kept"),
    (80.0, 50000.0, "", 80.0, 8000.0, "unit"), (1000.0, 0.0, "", 1000.0, 0.0, "kept"),
    (900000.0, 0.0, "", 90.0, 9000.0, "divided"), (12000000.0, 0.0, "", 120.0, 12000.0, "divided"),
    (900000.0, 0.0, "急售 85.5万", 85.5, 8550.0, "title"), (900000.0, 0.0, "2万起", 90.0, 9000.0, "divided"),
    (1200.0, 0.0, "", 0.12, 12.0, "divided"), (600000000.0, 0.0, "", 60000.0, 6000000.0, "divided_other"),
]


def test_price_repair(spark):
    df = spark.createDataFrame([(i, t, u, 100.0, s) for i, (t, u, s, *_) in enumerate(REPAIRS)],
                               "i int, t double, u double, a double, s string")
    rows = housing.repair_prices(df, "t", "u", "a", "s", F.lit(True)).orderBy("i").collect()
    assert [(r.t, r.u, r.repair_rule) for r in rows] == [x[3:] for x in REPAIRS]


def test_orientation_order(spark):
    r = one(spark, a=housing.orientation_code(F.lit("东南")), b=housing.orientation_code(F.lit("东南"), corrected=True),
            c=housing.orientation_code(F.lit("东")), d=housing.orientation_code(F.lit("北")))
    assert (r.a, r.b, r.c, r.d) == (3, 2, 1, 0)


def test_community_fallbacks(spark):
    r = one(spark, a=housing.community_from(F.lit("龙湖3室2厅"), F.lit("x")),
            b=housing.community_from(F.lit(""), F.lit("急售 恒大城 三房 便宜")), c=housing.community_from(F.lit(""), F.lit("x")))
    assert (r.a, r.b, r.c) == ("龙湖", "恒大城", "")


def test_feed_key_prints_unreadable_numbers_differently(spark):
    df = spark.createDataFrame([("c", "d", "x", "3", "0"), ("c", "d", "0", "3", "0"), ("c", "d", "", "3", "0")],
                               "community string, district string, area string, rooms string, total_price string")
    keys = [r.fingerprint for r in identity.with_feed_fingerprint(df).collect()]
    import hashlib
    def md5(s): return hashlib.md5(s.encode()).hexdigest()
    assert keys[0] == md5("c|d|0|3|0.0") and keys[1] == md5("c|d|0.0|3|0.0") and keys[2] == keys[1]


def test_stored_key(spark):
    import hashlib
    row = ("标题" * 50, "小区", "渝中区", 89.25, 3, 120.35, "anjuke", "7")
    df = spark.createDataFrame([row, row[:6] + ("lianjia", "7")],
                               "title string, community string, district string, area double, rooms int, total_price double, source string, source_id string")
    a, b = [r.fingerprint for r in identity.with_stored_fingerprint(df).collect()]
    want = f"{row[0][:60]}|小区|渝中区|{89.25:.1f}|3|{120.35:.1f}"
    assert a == "ajk_" + hashlib.md5(want.encode()).hexdigest()[:16] and b == "lj_7"


def test_texts(spark):
    r = one(spark, a=text.distance_text(F.lit(999.9)), b=text.distance_text(F.lit(1549.0)), c=text.compact_number(F.lit(12345)),
            d=text.parse_string_list(F.lit("broken")), e=text.parse_string_list(F.lit('["a","b"]')), f=text.strip_bom(F.lit("﻿id")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("999m", "1.5km", "1.2万", [], ["a", "b"], "id")


def test_distance(spark):
    r = one(spark, d=geo.haversine_m(F.lit(29.5), F.lit(106.5), F.lit(29.6), F.lit(106.5)))
    assert abs(r.d - 11119.5) < 60


def test_urls(spark):
    u = F.array(*map(F.lit, ["https://h/a.jpg!x", "https://h/a.jpg", "https://h/b.280x210.jpg", "https://h/b.600x450.jpg"]))
    r = one(spark, a=markup.distinct_by_base(u), b=markup.url_without_query(F.lit("//h/a.jpg?w=1")), c=markup.with_scheme(F.lit("//h/a")))
    assert r.a == ["https://h/a.jpg!x", "https://h/b.280x210.jpg"] and (r.b, r.c) == ("//h/a.jpg", "https://h/a")


def test_element_text_is_found_by_class(spark):
    html = F.lit('<div class="x-title">no</div><p class="big title new"><span>三</span><span>室 </span>&amp; more</p>')
    assert one(spark, a=markup.element_text(html, "title")).a == "三室& more"


def test_absent_numbers_are_not_parsed(spark):
    from dwellframe.functions import housing as h
    df = spark.createDataFrame([("3室",), ("none",), ("",), (None,)], "t string")
    found = df.select(h.count_before(F.col("t"), h.ROOMS).alias("n"))
    assert [r["n"] for r in found.collect()] == [3, 0, 0, 0]
    assert "nullif" in found._jdf.queryExecution().analyzed().toString()
