"""Aggregate functions and their modifiers.

Where a modifier needs an order inside a group, the values of that group are
collected and sorted; sums, counts and sketches combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def array_agg(x: Column, order_by: Column | None = None, descending: bool = False, distinct: bool = False, ignore_nulls: bool = True, limit: int | None = None) -> Column:
    """ARRAY_AGG([DISTINCT] x [IGNORE NULLS] [ORDER BY key] [LIMIT n]); NULLs kept only if asked for."""
    key = x if order_by is None else order_by
    entry = F.struct(key.alias("key"), x.alias("value"))
    entry = F.when(x.isNotNull(), entry) if ignore_nulls else entry
    values = F.sort_array(F.collect_set(entry) if distinct else F.collect_list(entry), asc=not descending)
    values = F.transform(values, lambda e: e["value"])
    return values if limit is None else F.slice(values, 1, limit)


def string_agg(x: Column, delimiter: str = ",", **modifiers) -> Column:
    return F.array_join(array_agg(x, **modifiers), delimiter)


def array_concat_agg(x: Column, order_by: Column) -> Column:
    entries = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order_by.alias("key"), x.alias("value")))))
    return F.flatten(F.transform(entries, lambda e: e["value"]))


def countif(condition: Column) -> Column:
    return F.count_if(condition)


def logical_and(x: Column) -> Column:
    return F.bool_and(x)


def logical_or(x: Column) -> Column:
    return F.bool_or(x)


def any_value(x: Column) -> Column:
    return F.any_value(x, ignoreNulls=True)


def max_by_having(x: Column, key: Column) -> Column:
    """ANY_VALUE(x HAVING MAX key)."""
    return F.max_by(x, key)


def min_by_having(x: Column, key: Column) -> Column:
    return F.min_by(x, key)


def having_extreme(df: DataFrame, keys: list[str], by: str, aggregates: dict[str, Column], largest: bool = True) -> DataFrame:
    """``AGG(x HAVING MAX by)`` (or MIN), for any aggregates: over the rows with the extreme ``by`` of their group.

    Groups are first aggregated by ``by`` as well, so no group is collected.  Rows with a NULL ``by`` do not count.
    """
    pick = F.max_by if largest else F.min_by
    by_value = df.filter(F.col(f"`{by}`").isNotNull()).groupBy(*keys, by).agg(*[a.alias(n) for n, a in aggregates.items()])
    best = by_value.groupBy(*keys).agg(pick(F.struct(*aggregates), F.col(f"`{by}`")).alias("best"))
    return best.select(*keys, "best.*")


def at_ranks(df: DataFrame, keys: list[str], x: Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group its number of values ``n`` and, under each name, the value of ``x`` at a rank; exact.

    A rank counts from 0 at the smallest value and is a function of ``n``.  NULLs do not count; a rank outside the
    group gives NULL.  Equal values are counted before they meet, and only distinct values are put in order.
    """
    own = [f"key_{i}" for i in range(len(keys))]
    counts = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], x.alias("value")).groupBy(*own, "value").agg(F.count("value").alias("rows"))
    group = W.partitionBy(*own)
    upto = F.sum("rows").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.select(*own, "value", "rows", upto.alias("upto"), F.sum("rows").over(group).alias("all"))
    n = F.col("all")
    picked = [F.min(F.when((rank(n) >= F.col("upto") - F.col("rows")) & (rank(n) < F.col("upto")), F.col("value"))) for rank in ranks.values()]
    return placed.groupBy(*own).agg(F.max("all"), *picked).toDF(*keys, "n", *ranks)


def approx_quantiles(df: DataFrame, keys: list[str], x: Column, n: int) -> DataFrame:
    """APPROX_QUANTILES, exact: per group n + 1 bounds as quantiles array, smallest and largest included; NULL without values."""
    # bound i is the smallest value with at least i / n of the values at or below it
    ranks = {f"bound_{i}": lambda count, i=i: F.greatest(F.lit(0), F.floor((count * i + (n - 1)) / n).cast("long") - 1) for i in range(n + 1)}
    bounds = at_ranks(df, keys, x, ranks)
    return bounds.select(*[F.col(f"`{k}`") for k in keys], F.when(F.col("n") > 0, F.array(*ranks)).alias("quantiles"))


def hll_init(x: Column, precision: int = 15) -> Column:
    """A sketch; its bytes are Spark's own."""
    return F.hll_sketch_agg(x, precision)


def hll_merge_partial(sketch: Column) -> Column:
    return F.hll_union_agg(sketch)


def hll_merge(sketch: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def hll_extract(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def top_count(df: DataFrame, keys: list[str], x: str, n: int) -> DataFrame:
    """APPROX_TOP_COUNT, exact: per group the n most frequent values as top array<struct<value,count>>; ties by value."""
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("count"))
    return _top(counts, keys, F.col("count"), F.struct(F.col(x).alias("value"), "count"), F.col(x), n)


def top_sum(df: DataFrame, keys: list[str], x: str, weight: str, n: int) -> DataFrame:
    """APPROX_TOP_SUM, exact: per group the n values of largest total weight."""
    sums = df.groupBy(*keys, x).agg(F.sum(weight).alias("sum"))
    return _top(sums, keys, F.col("sum"), F.struct(F.col(x).alias("value"), "sum"), F.col(x), n)


def _top(df: DataFrame, keys: list[str], size: Column, entry: Column, value: Column, n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(size.desc(), value.asc()))
    kept = df.withColumn("place", place).filter(F.col("place") <= n)
    entries = F.sort_array(F.collect_list(F.struct("place", entry.alias("entry"))))
    return kept.groupBy(*keys).agg(F.transform(entries, lambda e: e["entry"]).alias("top"))
