"""INSERT, UPDATE, DELETE and MERGE as transformations of immutable tables.

Parquet tables are not changed in place: each function returns the table's
new rows, to be written beside the old ones and swapped in (``Catalog``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows are matched by name; columns that they lack are NULL."""
    return target.unionByName(rows, allowMissingColumns=True).select(target.columns)


def update(target: DataFrame, assignments: dict[str, Column], where: Column) -> DataFrame:
    """A NULL condition changes nothing; assignments see the old values."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


@dataclass
class When:
    """One WHEN clause: kind 'matched', 'not_matched' or 'not_matched_by_source'; action 'update', 'delete' or 'insert'."""

    kind: str
    action: str
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, key: str, clauses: list[When]) -> DataFrame:
    """MERGE on an equal key: one full outer join, the first clause that holds decides a row.

    Values and conditions refer to ``t.column`` and ``s.column``.  A target
    row matched by several source rows is an error of the statement and is
    raised when it is read.
    """
    t = target.withColumn("in_t", F.lit(True)).alias("t")
    # counted where the join deals the rows to anyway; a null key matches nothing and its row stays
    n_same = F.count("*").over(W.partitionBy(key))
    s = source.withColumn("n_same", n_same).withColumn("in_s", F.lit(True)).alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    matched, only_s, only_t = F.col("in_t") & F.col("in_s"), F.col("in_t").isNull(), F.col("in_s").isNull()
    kinds = {"matched": matched, "not_matched": only_s, "not_matched_by_source": only_t}
    chosen = None
    for i, clause in enumerate(clauses):
        holds = F.coalesce(kinds[clause.kind], F.lit(False)) & F.coalesce(clause.condition if clause.condition is not None else F.lit(True), F.lit(False))
        chosen = F.when(holds, F.lit(i)) if chosen is None else chosen.when(holds, F.lit(i))
    both = both.withColumn("chosen", chosen.otherwise(F.lit(-1)))
    double = F.when(F.coalesce(matched, F.lit(False)) & (F.col("n_same") > 1) & (F.col("chosen") >= 0), F.raise_error(F.lit("MERGE: several source rows match one target row")))
    gone = [i for i, c in enumerate(clauses) if c.action == "delete"]
    both = both.filter((F.col("chosen") >= 0) | F.col("in_t")).filter(~F.col("chosen").isin(*gone) if gone else F.lit(True))
    columns = []
    for name in target.columns:
        value = F.when(F.coalesce(double.cast("boolean"), F.lit(False)), F.lit(None))
        for i, clause in enumerate(clauses):
            if clause.action == "update" and name in clause.values:
                value = value.when(F.col("chosen") == i, clause.values[name])
            elif clause.action == "insert":
                value = value.when(F.col("chosen") == i, clause.values.get(name, F.lit(None)))
        columns.append(value.otherwise(F.col(f"t.{name}")).cast(target.schema[name].dataType).alias(name))
    return both.select(*columns)
