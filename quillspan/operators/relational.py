"""Relational operators that Spark's DataFrame API lacks or spells differently."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def star_except(df: DataFrame, *names: str) -> DataFrame:
    """``SELECT * EXCEPT (names)``; an unknown name is an error."""
    unknown = set(names) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.drop(*names)


def star_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``SELECT * REPLACE (expr AS name)``: the places of the columns stay."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """``QUALIFY``: filter on a window expression without keeping it."""
    name = "qualify_"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, condition).filter(F.col(name)).drop(name)


def pivot(df: DataFrame, keys: list[str], column: str, values: dict, aggregates: dict[str, Column]) -> DataFrame:
    """``PIVOT`` with given values (value -> column prefix), so no pass finds them; one aggregation."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(*[a.alias(n) for n, a in aggregates.items()])
    names = list(keys)
    for prefix in values.values():
        names += [prefix if len(aggregates) == 1 else f"{n}_{prefix}" for n in aggregates]
    return out.toDF(*names)


def unpivot(df: DataFrame, columns: list[str], value: str, name: str, keep_nulls: bool = False) -> DataFrame:
    """``UNPIVOT``: the other columns, then the value, then its column's name."""
    ids = [c for c in df.columns if c not in columns]
    out = df.unpivot(ids, columns, name, value)
    return (out if keep_nulls else out.filter(F.col(value).isNotNull())).select(*ids, value, name)


def unnest(df: DataFrame, array: str, alias: str, offset: str | None = None, outer: bool = False) -> DataFrame:
    """``df, UNNEST(array) AS alias [WITH OFFSET AS offset]``; ``outer`` is the LEFT JOIN form. Offsets start at 0."""
    explode = F.posexplode_outer if outer else F.posexplode
    found = df.select("*", explode(F.col(array)).alias("offset_", alias))
    return found.drop("offset_") if offset is None else found.withColumnRenamed("offset_", offset)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), frames).distinct()


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def select_as_struct(df: DataFrame, name: str = "value") -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def select_as_value(df: DataFrame, name: str = "value") -> DataFrame:
    """One struct column becomes the row."""
    return df.select(f"{name}.*")


def order_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """(column, 'asc' or 'desc'): NULLs first ascending, last descending."""
    return df.orderBy(*[F.col(c).asc_nulls_first() if way == "asc" else F.col(c).desc_nulls_last() for c, way in keys])


def join_using(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: the key columns come once, first, and are coalesced in outer joins."""
    return left.join(right, names, how)


def array_subquery(outer: DataFrame, inner: DataFrame, on: dict[str, str], value: str, order_by: str, name: str) -> DataFrame:
    """``ARRAY(SELECT value FROM inner WHERE inner.b = outer.a ... ORDER BY order_by)``; ``on`` maps a to b.

    NULL values stay; outer rows without an inner one get an empty array.
    """
    keys = list(on.values())
    entry = F.struct(F.col(f"`{order_by}`").alias("key"), F.col(f"`{value}`").alias("value"))
    lists = inner.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries")).toDF(*[f"{k} of inner" for k in keys], "entries of inner")
    found = outer.join(lists, reduce(lambda x, y: x & y, [outer[f"`{a}`"] == lists[f"`{b} of inner`"] for a, b in on.items()]), "left")
    empty = F.array().cast(T.ArrayType(inner.schema[value].dataType))
    values = F.coalesce(F.transform("entries of inner", lambda e: e["value"]), empty)
    return found.select(*[outer[f"`{c}`"] for c in outer.columns], values.alias(name))


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """CROSS JOIN and the comma: the result is of the product's size, so one side should be small."""
    return left.crossJoin(right)


def unnest_left(df: DataFrame, array: Column, name: str, on: Callable[[Column], Column] | None = None) -> DataFrame:
    """LEFT JOIN UNNEST(array) ON ...: rows without a matching element stay, with NULL."""
    return df.withColumn(name, F.explode_outer(F.filter(array, on) if on else array))
