"""Connected components of an edge table by alternating large and small stars.

Every round is a fixed number of grouped minima and joins; no neighbourhood is
collected, and no edge leaves the executors.  A hub's edges are pre-aggregated
for its minimum, and adaptive execution splits them in the join.  Rounds are
cut by written tables, of which only the newest stays, and end when the edge
set no longer changes; their number grows with the logarithm of the longest
path.

Defined cases: repeated edges and loops change nothing; an edge with a null
end is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.scratch import discard, keep_at, new_folder


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in ``edges`` (a long, b long); the component is its smallest node."""
    spark = edges.sparkSession
    path = new_folder(spark, "edges")
    now = keep_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _minimum(both).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = _minimum(large)
        small = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        before, old, path = state, path, new_folder(spark, "edges")
        now = keep_at(small.unionAll(least.select("a", F.col("low").alias("b"))).distinct(), path)
        state = _state(now)
        discard(spark, old)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
