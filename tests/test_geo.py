"""Distances on the ellipsoid against the iteration in plain Python and known lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dwellframe.functions.geo import WGS84_A, WGS84_B, WGS84_F, ellipsoid_m, haversine_m


def vincenty(lat1, lng1, lat2, lng2):
    """Metres, or None where the iteration does not settle."""
    u1, u2 = (math.atan((1 - WGS84_F) * math.tan(math.radians(x))) for x in (lat1, lat2))
    l = math.radians(lng2 - lng1)
    l = math.atan2(math.sin(l), math.cos(l))
    lam, moved = l, 1.0
    for _ in range(21):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(ss, cs)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / ss if ss > 0 else 0.0
        a = 1 - sa * sa
        m = cs - 2 * math.sin(u1) * math.sin(u2) / a if a > 0 else 0.0
        c = WGS84_F / 16 * a * (4 + WGS84_F * (4 - 3 * a))
        new = l + (1 - c) * WGS84_F * sa * (sigma + c * ss * (m + c * cs * (2 * m * m - 1)))
        last, moved, lam = lam, abs(new - lam), new
    if moved > 1e-9:
        return None
    u = a * (WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2
    big, small = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768)), u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    return WGS84_B * big * (sigma - small * ss * (m + small / 4 * (
        cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3))))


def test_equals_the_plain_iteration(spark):
    rng = random.Random(6)
    pairs = [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(200)]
    pairs += [(29.5, 106.5, 29.5 + rng.uniform(-.1, .1), 106.5 + rng.uniform(-.1, .1)) for _ in range(100)]
    pairs += [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 1.0), (90.0, 0.0, -90.0, 0.0), (0.0, 179.9, 0.0, -179.9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    got = {r["i"]: r["m"] for r in df.select("i", ellipsoid_m(*map(F.col, "abcd")).alias("m")).collect()}
    for i, p in enumerate(pairs):
        want = vincenty(*p)
        assert want is None or got[i] == pytest.approx(want, abs=1e-3)
    assert got[300] == 0 and got[301] == pytest.approx(111319.491, abs=1e-3) and got[302] == pytest.approx(20003931.459, abs=1e-2)


def test_opposite_points_and_nulls(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (None, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = df.select(ellipsoid_m(*map(F.col, "abcd")).alias("m"), haversine_m(*map(F.col, "abcd")).alias("h")).collect()
    assert got[0]["m"] == got[0]["h"] and got[1]["m"] is None
