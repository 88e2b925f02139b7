"""Constructors, a pinned clock, older JSON names, join forms and more window statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import dates, strings
from quillspan.functions import json_functions as J
from quillspan.functions import windows as V
from quillspan.operators import relational
from quillspan.sources.tables import read_table


def constructors(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    key, day = F.col("o_orderkey"), dates.date_of(F.col("o_orderdate"))
    time = dates.make_time(key % 24, key % 60, F.lit(7))
    stamp = dates.datetime_of(day, time)
    return o.select(
        "o_orderkey", F.make_date(F.year(day), F.month(day), (key % 28 + 1).cast("int")).alias("made"), day.alias("day"), stamp.alias("stamp"), dates.time_of(stamp).alias("of_day"),
        dates.format_time("%H:%M:%S", time).alias("clock"), F.timestamp_millis(key * 1000003).alias("ms"), F.timestamp_micros(key * 1000003).alias("us"),
        dates.date_of(stamp, "Asia/Tokyo").alias("tokyo_day"), dates.format_timestamp("%Y-%m-%d %H:%M", stamp, "Asia/Tokyo").alias("tokyo"),
        dates.timestamp_of(day, "Asia/Tokyo").alias("from_tokyo"), dates.format_datetime("%%%F%%", stamp).alias("escaped"),
    )


def pinned_clock(spark: SparkSession, d: str) -> DataFrame:
    clock = dates.Clock(datetime.datetime(1998, 8, 2, 20, 30, 15))
    return read_table(spark, d, "orders").select(
        "o_orderkey", F.datediff(clock.current_date(), F.col("o_orderdate").cast("date")).alias("age"), (clock.current_date("Asia/Tokyo") > F.col("o_orderdate").cast("date")).alias("before"),
        (F.unix_micros(clock.current_timestamp()) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("micros"), clock.current_time("Asia/Tokyo").alias("time"),
    )


def json_extracts(spark: SparkSession, d: str) -> DataFrame:
    e, p = read_table(spark, d, "events"), F.col("props")
    listed = F.concat(F.lit("["), F.col("user_id"), F.lit(',"'), F.col("event_type"), F.lit('"]'))
    nested = F.concat(F.lit('{"a":'), listed, F.lit("}"))
    return e.select(
        "event_id", J.json_extract(p, "$.k").alias("k"), J.json_extract_scalar(p, "$.k").alias("scalar"), J.json_extract_scalar(nested, "$.a").alias("no_scalar"),
        J.json_extract_array(nested, "$.a").alias("elements"), J.json_extract_string_array(listed).alias("strings"),
        J.to_json(F.struct(F.col("user_id").alias("u"), F.nullif(F.col("event_type"), F.lit("click")).alias("t"))).alias("made"),
    )


def join_using(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = read_table(spark, d, "orders").groupBy((F.col("o_custkey") + 100).alias("k")).agg(F.count("*").alias("n"))
    return relational.join_using(c, o, ["k"], "full")


def cross_join(spark: SparkSession, d: str) -> DataFrame:
    r, n = read_table(spark, d, "region"), read_table(spark, d, "nation")
    return relational.cross_join(r.select("r_regionkey"), n).select("r_regionkey", "n_nationkey", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


def unnest_left(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return relational.unnest_left(e.select("vec_id", "embedding"), F.col("embedding"), "x", lambda x: x > 0.25).select("vec_id", F.col("x").cast("double").alias("x"))


def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    s, x, y = read_table(spark, d, "supplier"), F.col("s_acctbal"), F.col("s_suppkey")
    nation = W.partitionBy("s_nationkey")
    before = nation.orderBy("s_suppkey").rowsBetween(-3, -1)
    odd = F.when(y % 2 == 1, x)
    return s.select(
        "s_suppkey", F.min(x).over(nation).alias("low"), F.any_value("s_nationkey").over(nation).alias("any"), F.round(F.avg(x).over(nation), 6).alias("mean"),
        F.round(F.var_pop(x).over(nation), 4).alias("vp"), F.round(F.variance(x).over(nation), 4).alias("vs"), F.round(F.stddev(x).over(nation), 6).alias("sd"),
        F.round(F.covar_samp(x, y.cast("double")).over(nation), 4).alias("cs"), F.sum(x).over(before).isNull().alias("nothing_before"), F.count("*").over(before).alias("n_before"),
        V.last_value(odd, nation.orderBy("s_suppkey").rowsBetween(W.unboundedPreceding, 0), ignore_nulls=True).alias("last_odd"),
        V.sum_distinct(F.lit(2**53) + y % 3, nation).alias("exact"), V.sum_distinct(F.when(y < 0, y), nation).alias("none"),
    )


def approx_count(spark: SparkSession, d: str) -> DataFrame:
    """The sketch is within a tenth of the exact count (its error is 2 % by parameter)."""
    # repeated values change no sketch; next to a distinct count there would be a sketch for every pair
    pairs = read_table(spark, d, "events").select("event_type", "user_id").distinct()
    e = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count("user_id").alias("users"))
    return e.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.1).alias("close"))


def format_literals(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    quoted = F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('" \\ '))
    return o.select(
        "o_orderkey", strings.format_("%T|%t", F.col("o_orderkey"), F.col("o_orderkey")).alias("number"), strings.format_("%T", F.col("o_orderdate").cast("date")).alias("day"),
        strings.format_("%T", quoted).alias("text"), strings.format_("%T", F.col("o_totalprice") > 1000).alias("flag"),
    )


QUERIES = {
    f.__name__: f for f in (constructors, pinned_clock, json_extracts, join_using, cross_join, unnest_left, window_statistics, approx_count, format_literals)
}

ORACLE = {
    "constructors": """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, o_orderkey % 60, 7.0) AS stamp FROM orders)
        SELECT k AS o_orderkey, make_date(year(day), month(day), k % 28 + 1) AS made, day, stamp, (k % 24 * 3600 + k % 60 * 60 + 7) * 1000000 AS of_day, strftime(stamp, '%H:%M:%S') AS clock,
        epoch_ms(k * 1000003) AS ms, make_timestamp(k * 1000003) AS us, (stamp + INTERVAL 9 HOUR)::DATE AS tokyo_day, strftime(stamp + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo,
        day::TIMESTAMP - INTERVAL 9 HOUR AS from_tokyo, '%' || strftime(stamp, '%Y-%m-%d') || '%' AS escaped FROM o""",
    "pinned_clock": """SELECT o_orderkey, CAST(DATE '1998-08-02' - o_orderdate::DATE AS INT) AS age, DATE '1998-08-03' > o_orderdate::DATE AS before,
        epoch_us(TIMESTAMP '1998-08-02 20:30:15') - epoch_us(o_orderdate) AS micros, CAST(19815000000 AS BIGINT) AS time FROM orders""",
    "json_extracts": """SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS scalar, CAST(NULL AS VARCHAR) AS no_scalar, [CAST(user_id AS VARCHAR), '"' || event_type || '"'] AS elements,
        [CAST(user_id AS VARCHAR), event_type] AS strings, '{"u":' || user_id || ',"t":' || CASE WHEN event_type = 'click' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS made FROM events""",
    "join_using": "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM customer) FULL JOIN (SELECT o_custkey + 100 AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)",
    "cross_join": "SELECT r_regionkey, n_nationkey, r_regionkey = n_regionkey AS own FROM region, nation",
    "unnest_left": """WITH x AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT e.vec_id, CAST(x.x AS DOUBLE) AS x FROM embeddings e LEFT JOIN x ON x.vec_id = e.vec_id AND x.x > 0.25""",
    "window_statistics": """SELECT s_suppkey, min(s_acctbal) OVER n AS low, s_nationkey AS any, round(avg(s_acctbal) OVER n, 6) AS mean, round(var_pop(s_acctbal) OVER n, 4) AS vp, round(var_samp(s_acctbal) OVER n, 4) AS vs,
        round(stddev_samp(s_acctbal) OVER n, 6) AS sd, round(covar_samp(s_acctbal, s_suppkey) OVER n, 4) AS cs, row_number() OVER o = 1 AS nothing_before, least(3, row_number() OVER o - 1) AS n_before,
        last_value(CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END IGNORE NULLS) OVER o AS last_odd,
        CAST((SELECT sum(v) FROM (SELECT DISTINCT 9007199254740992 + t.s_suppkey % 3 AS v FROM supplier t WHERE t.s_nationkey = s.s_nationkey)) AS BIGINT) AS exact, CAST(NULL AS BIGINT) AS none
        FROM supplier s WINDOW n AS (PARTITION BY s_nationkey), o AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""",
    "approx_count": "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type",
    "format_literals": """SELECT o_orderkey, o_orderkey || '|' || o_orderkey AS number, 'DATE "' || strftime(o_orderdate, '%Y-%m-%d') || '"' AS day,
        '"say ' || chr(92) || '"' || o_orderpriority || chr(92) || '" ' || chr(92) || chr(92) || ' "' AS text, CASE WHEN o_totalprice > 1000 THEN 'true' ELSE 'false' END AS flag FROM orders""",
}
