"""Grouping, aggregate functions and their modifiers, sketches, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import aggregates as A
from quillspan.sources.tables import read_table
from quillspan.streaming import events as streaming


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.grouping_id().cast("int").alias("level"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def having(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 12")


def basic_aggregates(spark: SparkSession, d: str) -> DataFrame:
    line = read_table(spark, d, "lineitem")
    flag = F.col("l_discount") > 0.05
    return line.groupBy("l_returnflag").agg(
        F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("suppliers"), A.countif(flag).alias("discounted"), A.logical_and(F.col("l_tax") >= 0).alias("all_taxed"),
        A.logical_or(flag).alias("any_discount"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.bit_and("l_partkey").alias("b_and"),
        F.bit_or("l_partkey").alias("b_or"), F.bit_xor("l_partkey").alias("b_xor"), F.round(F.avg("l_quantity"), 6).alias("mean"),
    )


def statistics(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    line = read_table(spark, d, "lineitem")
    return line.groupBy("l_linestatus").agg(
        F.round(F.corr(x, y), 6).alias("corr"), F.round(F.covar_pop(x, y), 2).alias("covar_pop"), F.round(F.covar_samp(x, y), 2).alias("covar_samp"), F.round(F.stddev_pop(x), 6).alias("sd_pop"),
        F.round(F.stddev_samp(x), 6).alias("sd_samp"), F.round(F.var_pop(x), 5).alias("var_pop"), F.round(F.var_samp(x), 5).alias("var_samp"),
    )


def ordered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(
        A.string_agg(F.col("n_name"), ";").alias("names"), A.array_agg(F.col("n_nationkey"), order_by=F.col("n_name"), descending=True, limit=3).alias("last_three"),
        A.array_agg(F.length("n_name"), distinct=True).alias("lengths"), A.max_by_having(F.col("n_name"), F.col("n_nationkey")).alias("newest"),
        A.min_by_having(F.col("n_name"), F.col("n_nationkey")).alias("oldest"), A.array_concat_agg(F.array("n_nationkey", "n_regionkey"), F.col("n_nationkey")).alias("pairs"),
    )


def top_count(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_count(read_table(spark, d, "events"), ["event_type"], "user_id", 3)
    return top.select("event_type", F.explode("top").alias("t")).select("event_type", F.col("t.value").alias("user_id"), F.col("t.count").alias("n"))


def top_sum(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_sum(read_table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")), ["o_orderstatus"], "o_custkey", "cents", 3)
    return top.select("o_orderstatus", F.explode("top").alias("t")).select("o_orderstatus", F.col("t.value").alias("custkey"), F.col("t.sum").alias("cents"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Outer quartile bounds."""
    q = A.approx_quantiles(read_table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), 4)
    return q.select("l_returnflag", F.get("quantiles", F.lit(0)).cast("double").alias("low"), F.get("quantiles", F.lit(4)).cast("double").alias("high"))


def hll(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per type, merged; the estimate is compared with the exact count within 3 per cent."""
    e = read_table(spark, d, "events")
    sketches = e.groupBy("event_type").agg(A.hll_init(F.col("user_id")).alias("s"))
    estimate = sketches.agg(A.hll_merge(F.col("s")).alias("estimate"), A.hll_extract(A.hll_merge_partial(F.col("s"))).alias("again"))
    exact = e.agg(F.count_distinct("user_id").alias("exact"))
    return estimate.crossJoin(exact).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"), (F.col("estimate") == F.col("again")).alias("same"))


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streaming.windowed_counts(read_table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streaming.sessions(read_table(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (rollup, cube, having, basic_aggregates, statistics, ordered_aggregates, top_count, top_sum, quantiles, hll, approx_distinct, event_windows, event_sessions)
}

ORACLE = {
    "rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 12",
    "basic_aggregates": """SELECT l_returnflag, count(*) AS rows, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_discount > 0.05) AS discounted, bool_and(l_tax >= 0) AS all_taxed,
        bool_or(l_discount > 0.05) AS any_discount, min(l_shipdate) AS first, max(l_shipdate) AS last, bit_and(l_partkey) AS b_and, bit_or(l_partkey) AS b_or, bit_xor(l_partkey) AS b_xor,
        round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
    "statistics": """SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_pop(l_quantity, l_extendedprice), 2) AS covar_pop,
        round(covar_samp(l_quantity, l_extendedprice), 2) AS covar_samp, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp,
        round(var_pop(l_quantity), 5) AS var_pop, round(var_samp(l_quantity), 5) AS var_samp FROM lineitem GROUP BY 1""",
    "ordered_aggregates": """SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, (list(n_nationkey ORDER BY n_name DESC))[1:3] AS last_three,
        list(DISTINCT CAST(length(n_name) AS INT) ORDER BY CAST(length(n_name) AS INT)) AS lengths, max_by(n_name, n_nationkey) AS newest, min_by(n_name, n_nationkey) AS oldest,
        flatten(list([n_nationkey, n_regionkey] ORDER BY n_nationkey)) AS pairs FROM nation GROUP BY 1""",
    "top_count": """SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3""",
    "top_sum": """SELECT o_orderstatus, o_custkey AS custkey, cents FROM (SELECT o_orderstatus, o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY cents DESC, o_custkey) <= 3""",
    "quantiles": "SELECT l_returnflag, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem GROUP BY 1",
    "hll": "SELECT count(DISTINCT user_id) AS exact, true AS near, true AS same FROM events",
    "approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}
