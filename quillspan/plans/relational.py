"""Scans, projections, joins, set operations, subqueries and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import changes, relational
from quillspan.sources.tables import read_table, wildcard_table


def filter_project(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").filter((F.col("o_totalprice") > 200000) & F.col("o_orderstatus").isin("O", "P"))
    return o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thousands"), F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


def star_except_replace(spark: SparkSession, d: str) -> DataFrame:
    n = relational.star_except(read_table(spark, d, "nation"), "n_regionkey")
    return relational.star_replace(n, n_name=F.lower("n_name"))


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers meet orders on one key; nation and region are left to the optimiser's size estimates."""
    joined = (
        read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def left_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("big_orders"))


def right_join(spark: SparkSession, d: str) -> DataFrame:
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


def full_join(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = read_table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    joined = c.join(s, c.c_nationkey == s.s_nationkey, "full")
    return joined.select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), "customers", "suppliers")


def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Unequal join of aggregated sides, so that its inputs stay small."""
    s = read_table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"))
    c = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return s.join(c, s.top < c["mean"] * 2).groupBy("s_nationkey").agg(F.count("*").alias("nations"))


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """IN and NOT EXISTS as semi and anti joins."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    with_orders = c.join(o.filter("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("urgent").alias("kind"))
    without = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", F.lit("none").alias("kind"))
    return with_orders.union(without)


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return (
        relational.union_distinct(c, s).withColumn("op", F.lit("union"))
        .union(relational.intersect_distinct(c, s).withColumn("op", F.lit("intersect")))
        .union(relational.except_distinct(n, s).withColumn("op", F.lit("except")))
        .union(c.limit(0).unionAll(n).withColumn("op", F.lit("all")))
        .union(c.intersectAll(s).withColumn("op", F.lit("intersect all")))
        .union(c.exceptAll(s).groupBy("k").agg(F.first("k").alias("same")).select("k").withColumn("op", F.lit("except all")))
    )


def order_limit(spark: SparkSession, d: str) -> DataFrame:
    o = relational.order_by(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), ("o_orderkey", "asc"))
    return o.offset(5).limit(20)


def pivot(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return relational.pivot(o, ["year"], "o_orderstatus", {"F": "filled", "O": "open", "P": "partial"}, {"n": F.count("o_orderkey")})


def unpivot(spark: SparkSession, d: str) -> DataFrame:
    line = read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
    return relational.unpivot(line, ["discount", "tax"], "amount", "kind")


def unnest_offset(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    spread = relational.unnest(e, "embedding", "x", "place")
    return spread.groupBy("place").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


def qualify(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.qualify(o, F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")) <= 2)


def correlated(spark: SparkSession, d: str) -> DataFrame:
    """A correlated scalar subquery: orders above their customer's average."""
    read_table(spark, d, "orders").createOrReplaceTempView("quillspan_orders")
    return spark.sql(
        "SELECT o_orderkey FROM quillspan_orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM quillspan_orders i WHERE i.o_custkey = o.o_custkey)"
    )


def parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "WITH big AS (SELECT * FROM {line} WHERE l_quantity >= :least) SELECT l_returnflag, count(*) AS n FROM big WHERE l_shipmode_or_flag IN (:a, :b) GROUP BY l_returnflag",
        args={"least": 30, "a": "R", "b": "N"},
        line=read_table(spark, d, "lineitem").withColumn("l_shipmode_or_flag", F.col("l_returnflag")),
    )


def recursive(spark: SparkSession, d: str) -> DataFrame:
    """WITH RECURSIVE: region keys, counted up to the table's size."""
    return spark.sql(
        "WITH RECURSIVE up(k) AS (SELECT min(r_regionkey) FROM {region} UNION ALL SELECT k + 1 FROM up WHERE k + 1 < 5) SELECT k, r_name FROM up JOIN {region} ON k = r_regionkey",
        region=read_table(spark, d, "region"),
    )


def wildcard(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    tables = {f"orders_{y}": o.filter(F.col("year") == y).select("o_orderkey", "o_totalprice") for y in (1993, 1994, 1995)}
    tables["orders_1995"] = tables["orders_1995"].drop("o_totalprice")
    return wildcard_table(tables, "orders_", {"1994", "1995"}).groupBy("_TABLE_SUFFIX").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("priced"))


def as_struct(spark: SparkSession, d: str) -> DataFrame:
    return relational.select_as_value(relational.select_as_struct(read_table(spark, d, "nation").select("n_nationkey", "n_name")))


def update_delete(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    raised = changes.update(c, {"c_acctbal": F.col("c_acctbal") + 100}, F.col("c_mktsegment") == "BUILDING")
    return changes.delete(raised, F.col("c_acctbal") < 0)


def insert_select(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return changes.insert(n, read_table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")))


def merge(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")).filter("k % 3 <> 0")
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return changes.merge(
        c, o, "k",
        [
            changes.When("matched", "delete", condition=F.col("s.spent") < 500000),
            changes.When("matched", "update", {"bal": F.col("t.bal") + 1}),
            changes.When("not_matched", "insert", {"k": F.col("s.k"), "bal": F.lit(0.0)}),
            changes.When("not_matched_by_source", "update", {"bal": F.lit(-1.0)}),
        ],
    )


QUERIES = {
    f.__name__: f
    for f in (
        filter_project, star_except_replace, distinct_values, inner_join, left_join, right_join, full_join, theta_join, semi_anti, set_operations, order_limit, pivot, unpivot,
        unnest_offset, qualify, correlated, parameters, recursive, wildcard, as_struct, update_delete, insert_select, merge,
    )
}

ORACLE = {
    "filter_project": "SELECT o_orderkey, o_totalprice / 1000 AS thousands, coalesce(o_orderpriority, 'none') AS priority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O', 'P')",
    "star_except_replace": "SELECT n_nationkey, lower(n_name) AS n_name FROM nation",
    "distinct_values": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "inner_join": """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS big_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY 1",
    "right_join": "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "full_join": """SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers
        FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey""",
    "theta_join": """SELECT s_nationkey, count(*) AS nations FROM (SELECT s_nationkey, max(s_acctbal) AS top FROM supplier GROUP BY 1)
        JOIN (SELECT c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY 1) ON top < mean * 2 GROUP BY 1""",
    "semi_anti": """SELECT c_custkey, 'urgent' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
        UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "set_operations": """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier), n AS (SELECT n_nationkey AS k FROM nation)
        SELECT k, 'union' AS op FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
        UNION ALL SELECT k, 'except' FROM (SELECT k FROM n EXCEPT SELECT k FROM s) UNION ALL SELECT k, 'all' FROM n
        UNION ALL SELECT k, 'intersect all' FROM (SELECT k FROM c INTERSECT ALL SELECT k FROM s)
        UNION ALL SELECT DISTINCT k, 'except all' FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)""",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "pivot": """SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'O') AS open,
        count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""",
    "unpivot": """SELECT l_returnflag, max(l_discount) AS amount, 'discount' AS kind FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, max(l_tax), 'tax' FROM lineitem GROUP BY 1""",
    "unnest_offset": """SELECT CAST(place - 1 AS INT) AS place, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 4) AS mean
        FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1""",
    "qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "parameters": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('R', 'N') GROUP BY 1",
    "recursive": "SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey < 5",
    "wildcard": """SELECT CAST(year(o_orderdate) AS VARCHAR) AS _TABLE_SUFFIX, count(*) AS n, count(*) FILTER (year(o_orderdate) = 1994) AS priced
        FROM orders WHERE year(o_orderdate) IN (1994, 1995) GROUP BY 1""",
    "as_struct": "SELECT n_nationkey, n_name FROM nation",
    "update_delete": """SELECT * FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)
        WHERE NOT c_acctbal < 0""",
    "insert_select": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region",
    "merge": """WITH t AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0),
        s AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
        SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN 0.0 WHEN s.k IS NULL THEN -1.0 ELSE t.bal + 1 END AS bal
        FROM t FULL JOIN s ON t.k = s.k WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND spent < 500000)""",
}
