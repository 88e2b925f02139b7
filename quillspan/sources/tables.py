"""Parquet tables and wildcard tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables; pruning and push-down are the reader's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wildcard_table(tables: dict[str, DataFrame], prefix: str, suffixes: set[str] | None = None) -> DataFrame:
    """Union of the tables whose name starts with ``prefix``; missing columns are NULL.

    ``_TABLE_SUFFIX`` holds the rest of the name.  ``suffixes`` selects tables
    while the plan is built, so that unwanted tables are never scanned.
    """
    chosen = []
    for name in sorted(tables):
        suffix = name[len(prefix):]
        if name.startswith(prefix) and (suffixes is None or suffix in suffixes):
            chosen.append(tables[name].withColumn("_TABLE_SUFFIX", F.lit(suffix)))
    if not chosen:
        raise ValueError(f"no table matches {prefix}*")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)
