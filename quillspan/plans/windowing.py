"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import windows as V
from quillspan.sources.tables import read_table


def ranking(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("band"))
    w = W.partitionBy("c_nationkey").orderBy("band")
    unique = W.partitionBy("c_nationkey").orderBy("band", "c_custkey")
    return c.select(
        "c_custkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("percent"), F.round(F.cume_dist().over(w), 6).alias("cume"),
        F.row_number().over(unique).alias("number"), F.ntile(4).over(unique).alias("quarter"),
    )


def navigation(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return o.select(
        "o_orderkey", F.lag("o_orderkey", 1).over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("after"), V.first_value(F.col("o_orderkey"), whole).alias("first"),
        V.last_value(F.col("o_orderkey"), whole).alias("last"), V.nth_value(F.col("o_orderkey"), 2, whole).alias("second"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")).withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    rows = W.partitionBy("o_custkey").orderBy("day", "o_orderkey").rowsBetween(-2, 1)
    near = W.partitionBy("o_custkey").orderBy("day").rangeBetween(-90, 0)
    return o.select("o_orderkey", F.sum("cents").over(rows).alias("around"), F.count("*").over(near).alias("recent"), F.max("cents").over(near).alias("most"))


def window_aggregates(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    w = W.partitionBy("s_nationkey")
    x, y = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    return s.select(
        "s_suppkey", V.count_distinct(F.floor(x / 1000), w).alias("bands"), F.round(V.sum_distinct(F.floor(x / 1000), w, "double"), 4).alias("band_sum"), F.round(V.avg_distinct(F.floor(x / 1000), w), 4).alias("band_mean"),
        F.round(F.corr(x, y).over(w), 5).alias("corr"), F.round(F.stddev_pop(x).over(w), 4).alias("sd"), F.round(F.var_samp(x).over(w), 2).alias("var"), F.count_if(x > 0).over(w).alias("positive"),
        F.round(F.covar_pop(x, y).over(w), 2).alias("cov"), F.array_size(V.array_agg(x, w)).alias("n"),
    )


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    found = V.percentiles(s, ["c_mktsegment"], F.col("c_acctbal"), {"cont": 0.25}, {"disc": 0.25})
    return found.select("c_mktsegment", F.round("cont", 4).alias("cont"), F.round("disc", 4).alias("disc")).distinct()


def running_text(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("n_regionkey").orderBy("n_name").rowsBetween(W.unboundedPreceding, W.currentRow)
    return read_table(spark, d, "nation").select("n_name", V.string_agg(F.col("n_name"), w, "/").alias("so_far"))


QUERIES = {f.__name__: f for f in (ranking, navigation, frames, window_aggregates, percentiles, running_text)}

ORACLE = {
    "ranking": """WITH c AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 500) AS band FROM customer)
        SELECT c_custkey, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense, round(percent_rank() OVER w, 6) AS percent, round(cume_dist() OVER w, 6) AS cume,
        CAST(row_number() OVER u AS INT) AS number, CAST(ntile(4) OVER u AS INT) AS quarter FROM c
        WINDOW w AS (PARTITION BY c_nationkey ORDER BY band), u AS (PARTITION BY c_nationkey ORDER BY band, c_custkey)""",
    "navigation": """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, first_value(o_orderkey) OVER a AS first, last_value(o_orderkey) OVER a AS last,
        nth_value(o_orderkey, 2) OVER a AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
        a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "frames": """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)
        SELECT o_orderkey, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around,
        count(*) OVER r AS recent, max(cents) OVER r AS most FROM o WINDOW r AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 90 PRECEDING AND CURRENT ROW)""",
    "window_aggregates": """SELECT s_suppkey, CAST(count(DISTINCT floor(s_acctbal / 1000)) OVER w AS BIGINT) AS bands, round(sum(DISTINCT floor(s_acctbal / 1000)) OVER w, 4) AS band_sum,
        round(avg(DISTINCT floor(s_acctbal / 1000)) OVER w, 4) AS band_mean, CASE WHEN count(*) OVER w > 1 THEN round(corr(s_acctbal, s_suppkey) OVER w, 5) END AS corr, round(stddev_pop(s_acctbal) OVER w, 4) AS sd,
        round(var_samp(s_acctbal) OVER w, 2) AS var, count(*) FILTER (s_acctbal > 0) OVER w AS positive, round(covar_pop(s_acctbal, s_suppkey) OVER w, 2) AS cov, CAST(count(*) OVER w AS INT) AS n
        FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
    "percentiles": "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS cont, round(quantile_disc(c_acctbal, 0.25), 4) AS disc FROM customer GROUP BY 1",
    "running_text": "SELECT n_name, string_agg(n_name, '/') OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS UNBOUNDED PRECEDING) AS so_far FROM nation",
}
