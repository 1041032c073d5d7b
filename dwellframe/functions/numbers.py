"""Number parsing, rounding and range helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(c: Column, default: float | None = None) -> Column:
    """Text to double; blank or malformed text gives ``default``."""
    text = F.btrim(c)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def as_double(df: DataFrame, name: str, default: float | None = None) -> Column:
    """Column as double; text is parsed, numbers are only cast."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_double(F.col(name), default)
    value = F.col(name).cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def as_int(df: DataFrame, name: str, default: int | None = None) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_int(F.col(name), default)
    value = F.col(name).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def to_int(c: Column, default: int | None = None) -> Column:
    """Text to int through double, cut towards zero ('3.7' -> 3)."""
    value = to_double(c).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def known_number(c: Column) -> Column:
    """Digits already cut out by a pattern; '' is ruled out first because a failing parse is slow."""
    return F.nullif(c, F.lit("")).try_cast("double")


def digits_to_double(c: Column) -> Column:
    """Drop everything but digits and dots, then parse ('120万' -> 120.0)."""
    return known_number(F.regexp_replace(c, "[^0-9.]+", ""))


def round_half_even(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    Spark's ``round`` works on the shortest decimal text, so 0.35 goes to 0.4
    although the stored value is below 0.35. Here the distance to both
    neighbouring ties is computed without rounding error: ``x`` is cut into a
    24-bit head and a remainder whose products with a small power of ten are
    exact. The argument is used several times: pass a plain column, not a deep
    expression.
    """
    p = F.lit(float(10 ** digits))
    x = x.cast("double")
    head = x.cast("float").cast("double")
    q = F.rint(x * p)
    rest = (x - head) * p
    # On an exact tie an odd q moves, an even one stays.
    odd = F.abs(q % F.lit(2.0)) * F.lit(1e-300)
    up = ((head * p - (q + 0.5)) + rest + odd > 0).cast("double")
    down = ((head * p - (q - 0.5)) + rest - odd < 0).cast("double")
    return (q + up - down) / p


def fixed_text(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, from the exact binary value."""
    return round_half_even(x, digits).cast(f"decimal(24,{digits})").cast("string")


def clip(c: Column, lo, hi) -> Column:
    """Limit to [lo, hi]; null stays null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def positive(c: Column) -> Column:
    """The number when above zero, else null: zero is the feeds' mark for 'missing'."""
    return F.when(c > 0, c)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(safe_ratio(100.0 * part, whole), digits)
