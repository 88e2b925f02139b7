"""Window functions that Spark spells differently or lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from quillspan.functions.aggregates import at_ranks


def first_value(x: Column, w: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.first(x, ignorenulls=ignore_nulls).over(w)


def last_value(x: Column, w: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.last(x, ignorenulls=ignore_nulls).over(w)


def nth_value(x: Column, n: int, w: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.nth_value(x, n, ignoreNulls=ignore_nulls).over(w)


def percentiles(df: DataFrame, keys: list[str], x: Column, cont: dict[str, float], disc: dict[str, float]) -> DataFrame:
    """``df`` with PERCENTILE_CONT and PERCENTILE_DISC OVER (PARTITION BY keys) under the given names.

    Each partition's values are counted and put in order once, and every row gets the result by a join: a window
    would hold a partition's values again for each of its rows.
    """
    ranks = {f"disc_{i}": lambda n, p=p: F.greatest(F.lit(0), F.ceil(n * p) - 1) for i, p in enumerate(disc.values())}
    for i, p in enumerate(cont.values()):
        ranks |= {f"low_{i}": lambda n, p=p: F.floor((n - 1) * p), f"high_{i}": lambda n, p=p: F.ceil((n - 1) * p)}
    own = [f"key_{i}" for i in range(len(keys))]
    found = at_ranks(df, keys, x, ranks).toDF(*own, "n", *ranks)

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"low_{i}").cast("double"), F.col(f"high_{i}").cast("double")
        share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    values = [between(i, p).alias(name) for i, (name, p) in enumerate(cont.items())] + [F.col(f"disc_{i}").alias(name) for i, name in enumerate(disc)]
    once = found.select(F.struct(*own).alias("of_partition"), F.struct(*values).alias("percentiles"))
    # null keys are a partition of their own
    same = F.struct(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)]).eqNullSafe(F.col("of_partition"))
    return df.join(once, same).select(*[F.col(f"`{c}`") for c in df.columns], "percentiles.*")


def count_distinct(x: Column, w: WindowSpec) -> Column:
    return F.size(F.collect_set(x).over(w)).cast("long")


def sum_distinct(x: Column, w: WindowSpec, kind: str = "bigint") -> Column:
    """In the type ``kind``, since a sum of INT64 stays exact; NULL where no value is."""
    values = F.collect_set(x.cast(kind)).over(w)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, b: a + b))


def avg_distinct(x: Column, w: WindowSpec) -> Column:
    return sum_distinct(x, w, "double") / F.nullif(count_distinct(x, w), F.lit(0))


def string_agg(x: Column, w: WindowSpec, delimiter: str = ",") -> Column:
    return F.array_join(F.collect_list(x).over(w), delimiter)


def array_agg(x: Column, w: WindowSpec, distinct: bool = False) -> Column:
    values = F.collect_list(x).over(w)
    return F.array_distinct(values) if distinct else values
