"""Distances on the earth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
# Semi-major axis in metres and flattening of the WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
STEPS = 20


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres (within about 0.5 % of the ellipsoid)."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = (F.pow(F.sin(dlat / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), F.lit(2.0)))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def within_degrees(lat: Column, lng: Column, lat0: float, lng0: float, metres: float) -> Column:
    """Latitude/longitude box around a point: a filter the parquet scan can use."""
    import math
    dlat = math.degrees(metres / EARTH_RADIUS_M) * 1.01
    shrink = max(math.cos(math.radians(min(89.0, abs(lat0) + dlat))), 1e-3)
    dlng = dlat / shrink
    return lat.between(lat0 - dlat, lat0 + dlat) & lng.between(lng0 - dlng, lng0 + dlng)


def _with(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))


def ellipsoid_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, steps: int = STEPS) -> Column:
    """Distance in metres on the WGS84 ellipsoid, by a fixed number of Vincenty steps.

    The steps do not settle for points nearly opposite each other; where the
    last one still moves the longitude by more than 1e-9, the great-circle distance stands in. Null where a coordinate is null.
    """
    def reduced(lat: Column) -> Column:
        return F.atan((1 - WGS84_F) * F.tan(F.radians(lat)))

    def arc(p: Column, lam: Column, use: Callable[[Column, Column], Column]) -> Column:
        """What ``use`` makes of the arc's terms at an auxiliary longitude."""
        x, y = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        return _with(lambda s: _with(
            lambda t: use(s, t),
            sigma=F.atan2(s["sin"], s["cos"]), sin_alpha=F.when(s["sin"] > 0, p["c1"] * p["c2"] * F.sin(lam) / s["sin"]).otherwise(0.0)),
            sin=F.sqrt(x * x + y * y), cos=p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam))

    def middle(p: Column, s: Column, cos2_alpha: Column) -> Column:
        return F.when(cos2_alpha > 0, s["cos"] - 2 * p["s1"] * p["s2"] / cos2_alpha).otherwise(0.0)

    def step(p: Column, lam: Column) -> Column:
        def use(s: Column, t: Column) -> Column:
            return _with(lambda q: _with(
                lambda c: p["l"] + (1 - c["c"]) * WGS84_F * t["sin_alpha"] * (t["sigma"] + c["c"] * s["sin"] * (
                    c["m"] + c["c"] * s["cos"] * (2 * c["m"] * c["m"] - 1))),
                c=WGS84_F / 16 * q["a"] * (4 + WGS84_F * (4 - 3 * q["a"])), m=middle(p, s, q["a"])),
                a=1 - t["sin_alpha"] * t["sin_alpha"])
        return arc(p, lam, use)

    def metres(p: Column, lam: Column) -> Column:
        def use(s: Column, t: Column) -> Column:
            return _with(lambda q: _with(
                lambda c: WGS84_B * c["a"] * (t["sigma"] - c["b"] * s["sin"] * (c["m"] + c["b"] / 4 * (
                    s["cos"] * (2 * c["m"] * c["m"] - 1)
                    - c["b"] / 6 * c["m"] * (4 * s["sin"] * s["sin"] - 3) * (4 * c["m"] * c["m"] - 3)))),
                a=1 + q["u"] / 16384 * (4096 + q["u"] * (q["u"] * (320 - 175 * q["u"]) - 768)),
                b=q["u"] / 1024 * (256 + q["u"] * (q["u"] * (74 - 47 * q["u"]) - 128)), m=middle(p, s, q["a"])),
                a=1 - t["sin_alpha"] * t["sin_alpha"],
                u=(1 - t["sin_alpha"] * t["sin_alpha"]) * ((WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2))
        return arc(p, lam, use)

    def whole(p: Column) -> Column:
        start = F.struct(p["l"].alias("lam"), F.lit(1.0).alias("moved"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda now, _: _with(
            lambda n: F.struct(n["lam"].alias("lam"), F.abs(n["lam"] - now["lam"]).alias("moved")), lam=step(p, now["lam"])))
        return _with(lambda e: F.when(e["moved"] <= 1e-9, metres(p, e["lam"])), lam=end["lam"], moved=end["moved"])

    around = F.radians(lng2 - lng1)
    found = _with(lambda u: _with(
        whole, l=u["l"], s1=F.sin(u["u1"]), c1=F.cos(u["u1"]), s2=F.sin(u["u2"]), c2=F.cos(u["u2"])),
        l=F.atan2(F.sin(around), F.cos(around)), u1=reduced(lat1), u2=reduced(lat2))
    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return F.when(known, F.coalesce(found, haversine_m(lat1, lng1, lat2, lng2)))
