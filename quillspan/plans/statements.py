"""Statements through the catalog, SQL with parameters, and function families that need values of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import aggregates as A
from quillspan.functions import arrays, conditional, dates, environment, maths, strings
from quillspan.functions import json_functions as J
from quillspan.operators import relational
from quillspan.operators.catalog import Catalog
from quillspan.operators.changes import When
from quillspan.sources.tables import read_table


def _cents(price: str):
    return F.round(F.col(price) * 100).cast("long").alias("cents")


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS, INSERT, UPDATE, DELETE, MERGE, a view and a function over all orders."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _cents("o_totalprice"))
    orders = Catalog(spark, ("shop", "sales"))
    orders.create("orders", o.filter("o_orderstatus <> 'P'"), columns=["k", "customer", "status", "cents"])
    orders.insert("orders", o.filter("o_orderstatus = 'P'").toDF("k", "customer", "status", "cents"))
    orders.update("orders", {"cents": F.col("cents") * 2}, F.col("status") == "P")
    orders.delete("orders", F.col("cents") < 10_000_000)
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    clauses = [
        When("matched", "delete", condition=F.col("s.n") == 1),
        When("matched", "update", {"cents": F.col("t.cents") + F.col("s.n")}),
        When("not_matched", "insert", {"k": F.col("s.k"), "customer": F.lit(None).cast("long"), "status": F.lit("new"), "cents": F.col("s.n")}),
    ]
    orders.merge("orders", lines, "k", clauses)
    orders.create_view("priced", lambda: orders.table("orders").filter("cents > 2"))
    orders.create_function("dollars", lambda x: x / 100)
    return orders.table("shop.sales.priced").select("k", "status", orders.call("dollars", F.col("cents")).alias("dollars"))


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Positional parameters and a named window in Spark's own SQL."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _cents("o_totalprice"))
    text = """SELECT o_orderkey, sum(cents) OVER w AS total, max(cents) OVER w AS most FROM {o}
        WHERE o_orderstatus = ? OR o_custkey IS NULL OR o_custkey < ? WINDOW w AS (PARTITION BY o_custkey)"""
    return spark.sql(text, args=["F", 50], o=o)


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    line = read_table(spark, d, "lineitem")
    sets = [["l_returnflag"], ["l_linestatus", "l_linenumber"], []]
    return line.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def having_max(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderpriority", _cents("o_totalprice"))
    return A.having_extreme(o, ["o_custkey"], "o_orderpriority", {"cents": F.sum("cents"), "n": F.count("*")})


def array_subquery(spark: SparkSession, d: str) -> DataFrame:
    c, o = read_table(spark, d, "customer").select("c_custkey"), read_table(spark, d, "orders")
    return relational.array_subquery(c, o, {"c_custkey": "o_custkey"}, "o_orderpriority", "o_orderkey", "priorities")


def quartiles(spark: SparkSession, d: str) -> DataFrame:
    """All five bounds of APPROX_QUANTILES(x, 4)."""
    q = A.approx_quantiles(read_table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), 4)
    return q.select("l_returnflag", F.posexplode("quantiles").alias("bound", "at")).select("l_returnflag", "bound", F.col("at").cast("double").alias("at"))


def function_aliases(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return read_table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.round(F.stddev(x), 6).alias("sd"), F.round(F.variance(x), 4).alias("var"), A.any_value(F.col("s_nationkey") + 1).alias("any"),
        F.round(F.sum(maths.power(x / 1000, F.lit(2))), 4).alias("squares"), F.sum(maths.ceiling(x)).cast("double").alias("up"),
    )


def chance(spark: SparkSession, d: str) -> DataFrame:
    drawn = read_table(spark, d, "customer").select("c_nationkey", environment.generate_uuid().alias("id"), environment.rand().alias("r"))
    shape = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return drawn.groupBy("c_nationkey").agg(F.count_distinct("id").alias("ids"), F.count_if(shape).alias("shaped"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("within"))


def collation(spark: SparkSession, d: str) -> DataFrame:
    """Groups and compares without regard to case."""
    e = read_table(spark, d, "orders")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    by = e.select(strings.collate(mixed).alias("name"), (strings.collate(mixed) == F.col("o_orderpriority")).alias("same"))
    return by.groupBy("name").agg(F.count("*").alias("n"), F.count_if("same").alias("same")).select(F.lower("name").cast("string").alias("name"), "n", "same")


def text_bytes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode("p_name", "UTF-8")
    return read_table(spark, d, "part").select(
        "p_partkey", strings.length_bytes(raw).alias("n"), strings.to_hex(strings.lpad_bytes(raw, 40, b"*")).alias("l"), strings.to_hex(strings.rpad_bytes(raw, 9, b"-")).alias("r"),
        strings.to_hex(strings.reverse_bytes(raw)).alias("back"), strings.to_hex(strings.trim_bytes(raw, b"abcde")).alias("t"), strings.to_hex(F.substring(raw, 2, 3)).alias("sub"),
    )


def code_values(spark: SparkSession, d: str) -> DataFrame:
    """Codes and normal forms compared by value."""
    k = F.col("p_partkey")
    codes = strings.to_code_points(F.concat(F.col("p_name"), F.lit("é€😀")))
    # the low forty bits; lpad alone would keep the high ones of a larger number
    forty = F.unhex(F.lpad(F.hex((k * 7_919_003).bitwiseAND((1 << 40) - 1)), 10, "0"))
    return read_table(spark, d, "part").select(
        k, F.array_join(codes.cast("array<string>"), ",").alias("codes"), strings.to_hex(strings.code_points_to_bytes(F.array(k % 256, (k * 7) % 256))).alias("bytes"),
        strings.to_base32(forty).alias("b32"), strings.normalize(F.concat(F.col("p_name"), F.lit("é")), "NFC").alias("nfc"),
        strings.normalize_and_casefold(F.concat(F.col("p_brand"), F.lit("Straße"))).alias("folded"),
    )


def intervals(spark: SparkSession, d: str) -> DataFrame:
    k, ts = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    i = dates.make_interval(k % 5, k % 17, k % 50, k % 70, k % 61)
    hours, days, less = dates.justify_hours(i), dates.justify_days(i), dates.interval_negate(i)
    span = dates.date_minus(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return read_table(spark, d, "orders").select(
        k, hours["days"].alias("h_days"), hours["micros"].alias("h_micros"), days["months"].alias("d_months"), days["days"].alias("d_days"), less["months"].alias("minus"),
        *[dates.interval_extract(p, i).alias(p.lower()) for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE")], span["days"].alias("span"),
        dates.datetime_sub(ts, 3, "HOUR").alias("earlier"), dates.time_sub(dates.make_time(k % 24, k % 60, F.lit(0)), 90, "MINUTE").alias("time"),
    )


def array_values(spark: SparkSession, d: str) -> DataFrame:
    ts, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    steps = arrays.generate_timestamp_array(ts, F.timestamp_micros(F.unix_micros(ts) + 10_800_000_000), 90, "MINUTE")
    pair = arrays.make_struct(a=k, b=F.col("o_orderstatus"))
    return read_table(spark, d, "orders").select(
        k, F.array_join(F.transform(steps, lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")), ",").alias("steps"),
        conditional.at_ordinal(F.array(k, k + 1, k + 2), F.lit(2)).alias("second"), pair["a"].alias("a"), pair["b"].alias("b"),
        conditional.is_not_distinct_from(F.nullif(k % 2, F.lit(0)), F.lit(None).cast("long")).alias("even"),
    )


def json_typed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    text = F.concat(F.lit('{"ok":'), (k % 2 == 0).cast("string"), F.lit(',"x":'), (k / 4).cast("decimal(18,2)").cast("string"), F.lit(',"a":['), k, F.lit(","), k + 1, F.lit("]}"))
    return read_table(spark, d, "events").select(
        k, J.bool_(J.get_field(text, "ok")).alias("ok"), J.float64(J.get_field(text, "x")).alias("x"), J.int64(J.subscript(J.subscript(text, "a"), 1)).alias("second"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        catalog_changes, parameters, grouping_sets, having_max, array_subquery, quartiles, function_aliases, chance, collation, text_bytes, code_values, intervals, array_values, json_typed,
    )
}

ORACLE = {
    "catalog_changes": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS cents FROM orders),
        t AS (SELECT * FROM o WHERE cents >= 10000000), s AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
        m AS (SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN 'new' ELSE status END AS status, coalesce(cents, 0) + coalesce(n, 0) AS cents FROM t FULL JOIN s ON t.k = s.k
              WHERE NOT (t.k IS NOT NULL AND coalesce(n, 0) = 1))
        SELECT k, status, cents / 100 AS dollars FROM m WHERE cents > 2""",
    "parameters": """SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS total, max(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS most
        FROM orders WHERE o_orderstatus = 'F' OR o_custkey IS NULL OR o_custkey < 50 WINDOW w AS (PARTITION BY o_custkey)""",
    "grouping_sets": """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())""",
    "having_max": """SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
        QUALIFY o_orderpriority = max(o_orderpriority) OVER (PARTITION BY o_custkey)) GROUP BY 1""",
    "array_subquery": "SELECT c_custkey, ARRAY(SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey) AS priorities FROM customer",
    "quartiles": """WITH q AS (SELECT l_returnflag, quantile_disc(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem GROUP BY 1)
        SELECT l_returnflag, CAST(unnest(range(5)) AS INT) AS bound, CAST(unnest(q) AS DOUBLE) AS at FROM q""",
    "function_aliases": """SELECT s_nationkey, round(stddev(s_acctbal), 6) AS sd, round(variance(s_acctbal), 4) AS var, s_nationkey + 1 AS any, round(sum(power(s_acctbal / 1000, 2)), 4) AS squares,
        CAST(sum(ceiling(s_acctbal)) AS DOUBLE) AS up FROM supplier GROUP BY 1""",
    "chance": "SELECT c_nationkey, count(*) AS ids, count(*) AS shaped, count(*) AS within FROM customer GROUP BY 1",
    "collation": "SELECT lower(o_orderpriority) AS name, count(*) AS n, count(*) AS same FROM orders GROUP BY 1",
    "text_bytes": """SELECT p_partkey, CAST(strlen(p_name) AS INT) AS n, lower(hex(encode(lpad(p_name, 40, '*')))) AS l, lower(hex(encode(rpad(p_name, 9, '-')))) AS r,
        lower(hex(encode(reverse(p_name)))) AS back, lower(hex(encode(trim(p_name, 'abcde')))) AS t, lower(hex(encode(substr(p_name, 2, 3)))) AS sub FROM part""",
    "code_values": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || 'é€😀', ''), lambda c: CAST(unicode(c) AS VARCHAR)), ',') AS codes,
        lower(printf('%02x%02x', p_partkey % 256, p_partkey * 7 % 256)) AS bytes,
        array_to_string(list_transform(range(8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((p_partkey * 7919003) >> (35 - 5 * CAST(i AS INT))) & 31 AS INT) + 1, 1)), '') AS b32,
        nfc_normalize(p_name || 'e' || chr(769)) AS nfc, lower(p_brand) || 'strasse' AS folded FROM part""",
    "intervals": """SELECT o_orderkey, o_orderkey % 50 + (o_orderkey % 70 * 60 + o_orderkey % 61) // 1440 AS h_days, (o_orderkey % 70 * 60 + o_orderkey % 61) % 1440 * 60000000 AS h_micros,
        o_orderkey % 5 * 12 + o_orderkey % 17 + o_orderkey % 50 // 30 AS d_months, o_orderkey % 50 % 30 AS d_days, -(o_orderkey % 5 * 12 + o_orderkey % 17) AS minus,
        (o_orderkey % 5 * 12 + o_orderkey % 17) // 12 AS year, (o_orderkey % 5 * 12 + o_orderkey % 17) % 12 AS month, o_orderkey % 50 AS day,
        (o_orderkey % 70 * 60 + o_orderkey % 61) // 60 AS hour, (o_orderkey % 70 * 60 + o_orderkey % 61) % 60 AS minute, CAST(o_orderdate::DATE - DATE '1995-01-01' AS BIGINT) AS span,
        o_orderdate::TIMESTAMP - INTERVAL 3 HOUR AS earlier, (o_orderkey % 24 * 60 + o_orderkey % 60 - 90 + 1440) % 1440 * 60000000 AS time FROM orders""",
    "array_values": """SELECT o_orderkey, array_to_string(list_transform(generate_series(o_orderdate::TIMESTAMP, o_orderdate::TIMESTAMP + INTERVAL 3 HOUR, INTERVAL 90 MINUTE),
        lambda t: strftime(t, '%Y-%m-%d %H:%M')), ',') AS steps, o_orderkey + 1 AS second, o_orderkey AS a, o_orderstatus AS b, o_orderkey % 2 = 0 AS even FROM orders""",
    "json_typed": "SELECT event_id, event_id % 2 = 0 AS ok, CAST(event_id AS DOUBLE) / 4 AS x, event_id + 1 AS second FROM events",
}
