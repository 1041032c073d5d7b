"""Wall-clock timestamps without a zone, read as UTC whatever the session zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wall(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _hours(span: Column) -> Column:
    return F.extract(F.lit("DAY"), span).cast("bigint") * 24 + F.extract(F.lit("HOUR"), span)


def utc_instant(wall: Column) -> Column:
    """TIMESTAMP_NTZ to TIMESTAMP. The difference of two zone-less values knows no daylight saving."""
    span = wall - _wall("1970-01-01")
    seconds = _hours(span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60
    rest = (F.extract(F.lit("SECOND"), span) * 1000000).cast("bigint")
    return F.timestamp_micros(seconds * 1000000 + rest)


def utc_wall(instant: Column) -> Column:
    """TIMESTAMP to TIMESTAMP_NTZ."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    return _wall("1970-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def hours_since(wall: Column, start: str) -> Column:
    return _hours(wall - _wall(start)).cast("int")
