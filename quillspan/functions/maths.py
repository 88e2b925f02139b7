"""Mathematical functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unless_null(columns: tuple[Column, ...], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), F.lit(None)).otherwise(value)


def greatest(*columns: Column) -> Column:
    """Any NULL gives NULL, unlike Spark's."""
    return _unless_null(columns, F.greatest(*columns))


def least(*columns: Column) -> Column:
    return _unless_null(columns, F.least(*columns))


def log(x: Column, base: Column | None = None) -> Column:
    """LOG(x) is the natural logarithm; LOG(x, base) the logarithm to the base."""
    return F.ln(x) if base is None else F.ln(x) / F.ln(base)


def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def ceiling(x: Column) -> Column:
    return ceil(x)


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero, at ``digits`` decimals."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(((a - a % F.nullif(b, F.lit(0))) / F.nullif(b, F.lit(0))).cast("long"))


def ieee_divide(x: Column, y: Column) -> Column:
    """No error for a zero divisor: infinities and NaN."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def is_inf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_negate(x: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("long"), x)


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def range_bucket(point: Column, bounds: Column) -> Column:
    """Number of bounds not above the point."""
    return F.when(point.isNull(), F.lit(None)).otherwise(F.size(F.filter(bounds, lambda b: b <= point)).cast("long"))


def bit_count_bytes(x: Column) -> Column:
    """BIT_COUNT(BYTES): set bits of all bytes."""
    pairs = F.regexp_extract_all(F.hex(x), F.lit("(..)"), 1)
    return F.aggregate(pairs, F.lit(0), lambda n, p: n + F.bit_count(F.conv(p, 16, 10).cast("int"))).cast("long")


def parse_numeric(text: Column) -> Column:
    """Text to NUMERIC, blanks around it allowed; unreadable text raises."""
    return F.trim(text).cast("decimal(38,9)")


def parse_bignumeric(text: Column) -> Column:
    return F.trim(text).cast("decimal(38,18)")
