"""Operators, predicates, conditionals and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """``a / b`` in FLOAT64; a zero divisor raises under ANSI settings."""
    return a.cast("double") / b.cast("double")


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def is_not_distinct_from(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def is_true(x: Column) -> Column:
    return x.eqNullSafe(F.lit(True))


def is_false(x: Column) -> Column:
    return x.eqNullSafe(F.lit(False))


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """Lazy: only the chosen branch is evaluated."""
    return F.when(condition, then).otherwise(otherwise)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def in_array(x: Column, array: Column) -> Column:
    """``x IN UNNEST(array)``."""
    return F.array_contains(array, x)


def at_offset(array: Column, i: Column) -> Column:
    """``array[OFFSET(i)]``: outside the array is an error, as is a negative index."""
    return F.when(i < 0, F.raise_error(F.lit("array offset is negative"))).otherwise(F.element_at(array, (i + 1).cast("int")))


def at_ordinal(array: Column, i: Column) -> Column:
    """``array[ORDINAL(i)]``."""
    return F.when(i < 1, F.raise_error(F.lit("array ordinal is below 1"))).otherwise(F.element_at(array, i.cast("int")))


def safe_offset(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def safe_ordinal(array: Column, i: Column) -> Column:
    return F.get(array, (i - 1).cast("int"))


def shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x.cast("long"), n)


def shift_right(x: Column, n: int) -> Column:
    return F.shiftright(x.cast("long"), n)


def _hex_text(text: Column) -> Column:
    return text.rlike("^[+-]?0[xX][0-9a-fA-F]+$")


def _from_hex(text: Column) -> Column:
    digits = F.conv(F.regexp_replace(text, "^[+-]?0[xX]", ""), 16, 10).cast("long")
    return F.when(F.startswith(text, F.lit("-")), -digits).otherwise(digits)


def cast_int64(text: Column) -> Column:
    """CAST(STRING AS INT64): hexadecimal text is accepted, anything else unreadable raises."""
    return F.when(_hex_text(text), _from_hex(text)).otherwise(text.cast("long"))


def safe_cast_int64(text: Column) -> Column:
    """SAFE_CAST(STRING AS INT64): unreadable text is NULL."""
    return F.when(_hex_text(text), _from_hex(text)).otherwise(text.try_cast("long"))


def safe_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def error(message: Column) -> Column:
    """ERROR(message); NULL in, NULL out."""
    return F.when(message.isNotNull(), F.raise_error(message))
