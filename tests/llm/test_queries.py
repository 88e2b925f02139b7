"""Queries with SQL equal DuckDB's answer; the n-gram join equals all pairs, and packing places every document once."""

import re
from collections import defaultdict

import duckdb
import hypothesis
import hypothesis.strategies as st
import pytest

from quillspan.llm import packing, registry

TABLES = "documents pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    answer = con.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in answer.fetchall())


def test_ngram_join_equals_all_pairs(spark, sf):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard"](spark, sf).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_packing_places_all_words_once(spark, sf):
    words = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    placed, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_best_fit_packing"](spark, sf).collect():
        placed[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert {i: sum(r.n_words for r in rows) for i, rows in placed.items()} == words
    assert all(sorted(r.piece for r in rows) == list(range(len(rows))) for rows in placed.values())
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 2048
        assert len({r.source for r in held}) == len(held) == len({r.cluster for r in held})


@hypothesis.given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.integers(0, 5)), max_size=40))
@hypothesis.settings(deadline=None)
def test_best_fit_equals_a_scan_of_all_bins(pieces):
    pieces.sort(key=lambda p: -p[0])
    got, _ = packing.best_fit(*map(list, zip(*pieces, strict=True)), 20) if pieces else ([], None)
    bins, want = [], []
    for length, source, cluster in pieces:
        fit = [(room, b) for b, (room, sources, clusters) in enumerate(bins) if room >= length and (source is None or source not in sources) and cluster not in clusters]
        if fit:
            _, b = min(fit)
        else:
            b = len(bins)
            bins.append((20, set(), set()))
        room, sources, clusters = bins[b]
        bins[b] = (room - length, sources | {source}, clusters | {cluster})
        want.append(b)
    assert got == want
