"""Array and struct functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def array_length(array: Column) -> Column:
    return F.array_size(array).cast("long")


def array_to_string(array: Column, delimiter: str, null_text: str | None = None) -> Column:
    """NULL elements are left out unless a text for them is given."""
    texts = array.cast("array<string>")
    return F.array_join(texts, delimiter) if null_text is None else F.array_join(texts, delimiter, null_text)


def array_reverse(array: Column) -> Column:
    return F.reverse(array)


def generate_array(start: Column, end: Column, step: Column | None = None) -> Column:
    """Empty when the step leads away from the end; INT64."""
    start, end = start.cast("long"), end.cast("long")
    step = F.lit(1).cast("long") if step is None else step.cast("long")
    forward = ((step > 0) & (start <= end)) | ((step < 0) & (start >= end))
    return F.when(forward, F.sequence(start, end, step)).otherwise(F.array().cast("array<bigint>"))


def generate_float_array(start: Column, end: Column, step: Column) -> Column:
    """FLOAT64 steps, computed from the start so that errors do not add up."""
    n = F.floor((end - start) / step).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step)).otherwise(F.array().cast("array<double>"))


def generate_date_array(start: Column, end: Column, n: int = 1, part: str = "DAY") -> Column:
    forward = (start <= end) if n > 0 else (start >= end)
    return F.when(forward, F.sequence(start, end, F.expr(f"INTERVAL '{n}' {part}"))).otherwise(F.array().cast("array<date>"))


def generate_timestamp_array(start: Column, end: Column, n: int, part: str) -> Column:
    forward = (start <= end) if n > 0 else (start >= end)
    return F.when(forward, F.sequence(start, end, F.expr(f"INTERVAL '{n}' {part}"))).otherwise(F.array().cast("array<timestamp>"))


def make_array(*values: Column) -> Column:
    return F.array(*values)


def make_struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])
