"""Small cases of table changes, the catalog and dialect functions."""

import base64
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.functions import aggregates, conditional, dates, hashing, maths, net, strings
from quillspan.operators import changes, relational
from quillspan.operators.catalog import Catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_merge_end_state(spark):
    inventory = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "product string, quantity long")
    arrivals = spark.createDataFrame([("b", 5), ("d", 7), ("c", 0)], "product string, quantity long")
    clauses = [
        changes.When("matched", "delete", condition=F.col("s.quantity") == 0),
        changes.When("matched", "update", {"quantity": F.col("t.quantity") + F.col("s.quantity")}),
        changes.When("not_matched", "insert", {"product": F.col("s.product"), "quantity": F.col("s.quantity")}),
    ]
    got = sorted(map(tuple, changes.merge(inventory, arrivals, "product", clauses).collect()))
    assert got == [("a", 10), ("b", 25), ("d", 7)]


def test_merge_rejects_two_sources(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v long")
    s = spark.createDataFrame([("a", 2), ("a", 3)], "k string, v long")
    with pytest.raises(Exception, match="several source rows"):
        changes.merge(t, s, "k", [changes.When("matched", "update", {"v": F.col("s.v")})]).collect()


def test_catalog_script(spark):
    c = Catalog(spark, ("project", "data"))
    c.create("t", "k long, v string")
    c.insert("t", spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string"))
    c.update("t", {"v": F.lit("z")}, F.col("v") == "y")
    c.delete("t", F.col("v") == "x")
    assert sorted(map(tuple, c.table("project.data.t").collect())) == [(2, "z"), (3, None)]
    c.create_view("v", lambda: c.table("t").filter("k = 3"))
    c.create("copy", c.table("v"), temporary=True)
    c.create_function("twice", lambda x: x + x)
    assert c.table("copy").select(c.call("twice", F.col("k")).alias("x")).first().x == 6
    c.truncate("t")
    assert c.table("t").count() == 0
    c.close()
    assert not c.exists("copy")
    assert ("table", "added", "project.data.t") in c.log


def test_star_and_unpivot_errors(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="no such columns"):
        relational.star_except(df, "nope")
    with pytest.raises(ValueError, match="no such columns"):
        relational.star_replace(df, nope=F.lit(1))


def test_function_cases(spark):
    assert one(spark, conditional.cast_int64(F.lit("0x87a"))) == 2170
    assert one(spark, conditional.cast_int64(F.lit("-0x87a"))) == -2170
    assert one(spark, maths.greatest(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, maths.range_bucket(F.lit(20), F.array(F.lit(0), F.lit(10), F.lit(20)))) == 3
    assert one(spark, strings.instr(F.lit("banana"), "an", -1, 1)) == 4
    assert one(spark, strings.instr(F.lit("banana"), "an", -1, 2)) == 2
    assert one(spark, strings.initcap(F.lit("hello WORLD-everyone!"))) == "Hello World-Everyone!"
    assert one(spark, strings.regexp_instr(F.lit("ab@cd.com ab@ef.com"), "@[^.]+", 1, 2)) == 13
    assert one(spark, strings.code_points_to_string(F.array(F.lit(65), F.lit(255), F.lit(513), F.lit(1024)))) == "AÿȁЀ"
    assert one(spark, dates.date_diff(F.lit("2017-12-18").cast("date"), F.lit("2017-12-17").cast("date"), "WEEK(MONDAY)")) == 1
    assert str(one(spark, dates.date_trunc(F.lit("2015-06-15").cast("date"), "ISOYEAR"))) == "2014-12-29"
    assert one(spark, net.host(F.lit("//user@Example.com:80/x"))) == "example.com"
    assert one(spark, net.reg_domain(F.lit("http://a.b.co.uk/"))) == "b.co.uk"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|division by zero"):
        one(spark, maths.div(F.lit(1), F.lit(0)))


def test_stream_equals_batch(spark, sf, tmp_path):
    from quillspan.streaming import events as streaming

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    query = streaming.windowed_counts(live).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    rows = lambda df: sorted(map(tuple, df.select("start", "event_type", "n").collect()))
    assert rows(spark.table("windowed")) == rows(streaming.windowed_counts(batch))


@pytest.mark.parametrize("text, print_", [("1footrue", -1541654101129638711), ("2applefalse", 2794438866806483259), ("3true", -4880158226897771312)])
def test_fingerprint_values(spark, text, print_):
    assert one(spark, hashing.farm_fingerprint(F.lit(text))) == print_


def test_fingerprint_of_all_lengths(spark):
    assert one(spark, hashing.farm_fingerprint(F.lit(None).cast("string"))) is None
    found = {hashing.fingerprint64(b"a" * n) for n in range(300)}
    assert len(found) == 300 and all(-(2**63) <= x < 2**63 for x in found)


def test_parse_numbers_and_times(spark):
    assert str(one(spark, maths.parse_numeric(F.lit(" -12.5 ")))) == "-12.500000000"
    assert one(spark, dates.parse_time("%H:%M", F.lit("01:02"))) == 3720 * 10**6


def test_text_codes_read_whole_texts(spark, tmp_path):
    from quillspan.plans import registry

    head = "the same twenty characters and more "
    texts = {1: head + "é€😀" * 3000, 2: head + "é€😀" * 2999 + "e\u0301", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.queries()["text_codes_whole"](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode() if isinstance(t, str) else t).hexdigest()
    for i in (1, 2):
        raw, plain = texts[i].encode(), md5(texts[i])
        want = {"hex": md5(raw.hex()), "unhex": plain, "b64": md5(base64.b64encode(raw)), "unb64": plain, "points": plain, "unb32": plain, "twice": md5(raw.hex()), "valid": plain}
        assert got[i].asDict() == want | {"doc_id": i, "chr": "t", "nfc": md5(unicodedata.normalize("NFC", texts[i]))}
    assert got[3].points == md5("") and got[4].hex is None and got[4].nfc is None


def test_format_literals_by_type(spark):
    assert one(spark, strings.format_("%T", F.lit(5))) == "5"
    assert one(spark, strings.format_("%T", F.lit(True))) == "true"
    assert one(spark, strings.format_("%T", F.lit('a "b"\nc'))) == '"a \\"b\\"\\nc"'
    assert one(spark, strings.format_("%T", F.lit("2020-01-02").cast("date"))) == 'DATE "2020-01-02"'


def test_clock_without_a_pin_moves(spark):
    import datetime

    today = one(spark, dates.Clock().current_date())
    assert abs((datetime.datetime.now(datetime.UTC).date() - today).days) <= 1
    with pytest.raises(ValueError, match="UTC"):
        dates.format_timestamp("%Z", F.current_timestamp(), "Asia/Tokyo")


def test_catalog_drops_are_logged_by_kind(spark):
    c = Catalog(spark, ("project", "data"))
    c.create("t", "k long")
    c.create_view("v", lambda: c.table("t"))
    c.create_function("f", lambda x: x)
    c.drop("v")
    c.drop_function("f")
    c.drop_function("f", if_exists=True)
    assert ("view", "deleted", "project.data.v") in c.log and ("function", "deleted", "f") in c.log
    with pytest.raises(KeyError):
        c.drop_function("f")


def test_changes_touch_only_files_with_hits(spark):
    import os

    c = Catalog(spark)
    c.create("t", "k long, v string")
    for k in (1, 2, 3):
        c.insert("t", spark.createDataFrame([(k, "old")], "k long, v string").coalesce(1))
    rows = lambda: sorted(map(tuple, c.table("t").collect()))
    of = lambda: {r.k: r.file for r in c.table("t").select("k", F.col("_metadata.file_name").alias("file")).collect()}
    first, old_version = of(), c.table("t")
    c.update("t", {"v": F.lit("new")}, F.col("k") == 2)
    second = of()
    assert rows() == [(1, "old"), (2, "new"), (3, "old")]
    assert second[1] == first[1] and second[3] == first[3] and second[2] != first[2]
    assert old_version.filter("v = 'old'").count() == 3
    clauses = [changes.When("matched", "update", {"v": F.col("s.v")}), changes.When("not_matched", "insert", {"k": F.col("s.k"), "v": F.col("s.v")})]
    c.merge("t", spark.createDataFrame([(3, "merged"), (4, "added"), (None, "none")], "k long, v string"), "k", clauses)
    assert sorted(map(tuple, c.table("t").collect()), key=repr) == [(1, "old"), (2, "new"), (3, "merged"), (4, "added"), (None, "none")]
    assert of()[1] == first[1] and of()[2] == second[2]
    c.delete("t", F.col("k") > 9)
    assert of()[1] == first[1] and c.table("t").count() == 5
    c.merge("t", spark.createDataFrame([(1, "x")], "k long, v string"), "k", [changes.When("not_matched_by_source", "delete")])
    assert rows() == [(1, "old")]
    assert c.expire() > 0 and c.expire() == 0
    assert rows() == [(1, "old")] and all(os.path.exists(f.removeprefix("file:")) for f in c.table("t").inputFiles())
    c.truncate("t")
    assert rows() == [] and c.table("t").columns == ["k", "v"]
    c.insert("t", spark.createDataFrame([("y",)], "v string"))
    assert rows() == [(None, "y")]


def test_work_tables_go_with_their_scope(spark):
    import os

    from quillspan.sources import scratch

    with scratch.work_tables(spark):
        kept = scratch.keep(spark.range(3), "scoped")
        (path,) = [p for p in scratch._SCOPES[-1] if "scoped" in p]
        assert kept.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_catalog_names_and_columns(spark):
    c = Catalog(spark, ("project",))
    c.add_name_path("data")
    c.create("t", spark.range(3), columns=["k"])
    assert c.table("project.data.t").columns == ["k"]
    c.create_view("v", lambda: c.table("t"))
    c.create_view("v", lambda: c.table("missing"), if_not_exists=True)
    assert c.table("v").count() == 3
    with pytest.raises(ValueError, match="view project.data.v exists"):
        c.create_view("v", lambda: c.table("t"))
    c.set_name_path("project", "other")
    with pytest.raises(KeyError, match="project.other.t"):
        c.table("t")


def test_having_extreme_and_array_subquery_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 2, 7), ("b", None, 9), (None, 3, 4)], "g string, o int, x int")
    best = aggregates.having_extreme(rows, ["g"], "o", {"s": F.sum("x"), "n": F.count("*")})
    assert {tuple(r) for r in best.collect()} == {("a", 7, 2), (None, 4, 1)}
    least = aggregates.having_extreme(rows, ["g"], "o", {"s": F.sum("x")}, largest=False)
    assert {tuple(r) for r in least.collect()} == {("a", 5), (None, 4)}
    outer = spark.createDataFrame([("a",), ("c",), (None,)], "g string")
    lists = relational.array_subquery(outer, rows.filter("g = 'a'"), {"g": "g"}, "x", "o", "xs")
    assert {(r.g, tuple(r.xs)) for r in lists.collect()} == {("a", (5, None, 7)), ("c", ()), (None, ())}


def test_collation_bytes_and_intervals(spark):
    assert one(spark, strings.collate(F.lit("Ab")) == F.lit("aB"))
    assert not one(spark, strings.collate(F.lit("Ab"), "binary") == F.lit("aB"))
    with pytest.raises(ValueError, match="no collation"):
        strings.collate(F.lit("x"), "und:xx")
    assert one(spark, strings.trim_bytes(F.unhex(F.lit("ff00ff")), b"\xff")) == b"\x00"
    assert one(spark, strings.lpad_bytes(F.unhex(F.lit("ff")), 3, b"\x01")) == b"\x01\x01\xff"
    back = dates.interval_negate(dates.make_interval(years=1, months=2, hours=25, minutes=61))
    got = [one(spark, dates.interval_extract(p, back)) for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE")]
    assert got == [-1, -2, 0, -26, -1]


def test_percentiles_of_a_large_partition(spark):
    import pandas as pd

    from quillspan.functions import windows

    # 20,000 different values in one partition, repeated ones and none in others, and a null key
    rows = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") / 4).alias("x"))
    rows = rows.union(spark.createDataFrame([("b", 2.0), ("b", 2.0), ("b", None), ("b", 9.0), ("c", None), (None, 1.0), (None, 3.0)], "g string, x double"))
    found = windows.percentiles(rows, ["g"], F.col("x"), {"cont": 0.3}, {"disc": 0.3, "last": 1.0})
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {tuple(r) for r in found.withColumn("cont", F.round("cont", 9)).drop("x").distinct().collect()}
    assert found.count() == 20_007
    assert got == {("a", round(pd.Series(range(20_000)).quantile(0.3) / 4, 9), 5999 / 4, 19_999 / 4), ("b", 2.0, 2.0, 9.0), ("c", None, None, None), (None, 1.6, 1.0, 3.0)}


def test_quantiles_are_exact(spark):
    rows = spark.range(300_000).select(F.lit("a").alias("g"), "id").union(spark.createDataFrame([("b", 5), ("b", None), ("c", None)], "g string, id long"))
    got = {r.g: r.quantiles for r in aggregates.approx_quantiles(rows, ["g"], F.col("id"), 4).collect()}
    assert got == {"a": [0, 74_999, 149_999, 224_999, 299_999], "b": [5] * 5, "c": None}


def test_code_values_of_large_keys(spark, tmp_path):
    from quillspan.plans import registry

    keys = [1, 138_846, 138_847, 1_200_000, 10**9]
    spark.createDataFrame([(k, "a", "b") for k in keys], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.b32 for r in registry.queries()["code_values"](spark, str(tmp_path)).collect()}
    assert got == {k: base64.b32encode((k * 7_919_003 % 2**40).to_bytes(5, "big")).decode() for k in keys}


def test_network_of_numbers_beyond_an_address(spark, tmp_path):
    from quillspan.plans import registry

    keys = [0, 65_535, 65_536, 70_000, 10**7, None]
    spark.createDataFrame([(k, "http://a.com/") for k in keys], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.ip, r.n, r.net) for r in registry.queries()["network"](spark, str(tmp_path)).collect()}
    parts = {k: (k * 65537 >> 24, (k * 65537 >> 16) % 256, (k * 65537 >> 8) % 256) for k in keys if k is not None}
    assert got == {k: (".".join(map(str, [*p, k % 256])), k * 65537, ".".join(map(str, [*p, 0]))) for k, p in parts.items()} | {None: (None, None, None)}
    assert one(spark, net.ipv4_from_int64(F.lit(-2))) == b"\xff\xff\xff\xfe"


def test_approx_count_has_a_sketch_a_type_only(spark, tmp_path):
    from quillspan.plans import registry

    rows = [("a", i % 500) for i in range(2000)] + [("b", None), (None, 1), (None, None)]
    spark.createDataFrame(rows, "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["approx_count"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", 500, True), ("b", 0, True), (None, 1, True)}
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()
    assert all("user_id" not in keys.split("]")[0] for keys in plan.split("Aggregate(keys=[")[1:] if "approx_count_distinct" in keys.split("\n")[0])


def test_code_functions_run_once_a_value(spark):
    codes = strings.to_code_points(F.col("t"))
    rows = spark.createDataFrame([("aé€😀",), ("",), (None,)], "t string").select(codes.alias("c"), strings.code_points_to_string(codes).alias("s"))
    assert [tuple(r) for r in rows.collect()] == [([97, 233, 8364, 128512], "aé€😀"), ([], ""), (None, None)]
    assert "ascii" not in rows._jdf.queryExecution().toString()
    lists = spark.createDataFrame([([65, None],), ([65, 0, 66],), ([],), (None,)], "c array<long>")
    assert [r.s for r in lists.select(strings.code_points_to_string(F.col("c")).alias("s")).collect()] == [None, "AB", "", None]
    for bad in (-1, 0x110000, 0xD800):
        with pytest.raises(Exception, match="code point|codec"):
            one(spark, strings.code_points_to_string(F.array(F.lit(bad))))
    for n in [*range(12), 1001, 1002]:
        data = bytes(i * 37 % 256 for i in range(n))
        assert strings.b32encode(data) == base64.b32encode(data).decode() and strings.b32decode(strings.b32encode(data)) == data
    for bad in ("AAAAAAA", "AAAAAAA*AAAAAAAA", "aaaaaaaaAAAAAAAA", "AAAAAAA=AAAAAAAA"):
        with pytest.raises(ValueError):
            strings.b32decode(bad)
