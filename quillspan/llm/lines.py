"""Operator 9, line deduplication over overlapping three-line windows.

Consecutive lines that have a word are hashed in windows of three.  A window
found again, in the same document or another, is a repeat: its first
occurrence (smallest document id, then line) stays, and the lines that later
occurrences cover are removed.  Overlapping repeats merge, as a document's
covered line numbers are united before they are cut.

Only hashes and line numbers are shuffled by window.  Counting is combined on
the map side, so a passage in a third of all documents is one row a task.  The
join that brings first occurrences back to the windows keeps the rows of hot
windows where they are and broadcasts those windows' first occurrences, of
which there is a fixed number at most (``common.HOT_KEYS``).

Defined cases: null text has no lines and stays null; documents of fewer than
three lines with a word are unchanged; lines without a word are skipped when
windows are formed and are never removed; lines compare after white space is
collapsed and trimmed; a window that overlaps its own first occurrence leaves
the lines of that occurrence alone; repeated rows are one document; null ids
come last; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import binary_text, join_hot, row_key, without_lines
from quillspan.sources.scratch import keep

WINDOW = 3
WINDOWS = "key binary, doc_id long, windows array<binary>, at array<array<int>>"
_ARROW = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("windows", pa.list_(pa.binary())), ("at", pa.list_(pa.list_(pa.int32())))])


def line_windows(text: bytes) -> tuple[list[bytes], list[list[int]]]:
    """128-bit hash and line numbers of every window of three consecutive lines with a word."""
    lines = [(number, b" ".join(own)) for number, line in enumerate(text.split(b"\n")) if (own := line.split())]
    hashes, at = [], []
    for i in range(len(lines) - WINDOW + 1):
        part = lines[i : i + WINDOW]
        hashes.append(xxhash.xxh3_128_digest(b"\n".join(line for _, line in part)))
        at.append([number for number, _ in part])
    return hashes, at


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_windows(text) for text in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), pa.array([h for h, _ in found], _ARROW.field(2).type), pa.array([a for _, a in found], _ARROW.field(3).type)]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _ARROW, strict=True)], schema=_ARROW)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, drop): the line numbers to remove from each document that has repeats."""
    key = row_key(docs[f"`{doc_id}`"], docs[f"`{text}`"])
    narrow = docs.select(key.alias("key"), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), binary_text(docs[f"`{text}`"]).alias("text"))
    per_doc = keep(narrow.mapInArrow(_window_batches, WINDOWS), "line-windows")
    windows = per_doc.select("key", "doc_id", F.explode(F.arrays_zip("windows", "at")).alias("w")).select(
        "key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", F.col("w.at").alias("at")).alias("place"), F.col("w.windows").alias("window")
    )
    counted = windows.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("times"))
    repeated = keep(counted.filter("first <> last").select("window", "first", "times"), "repeated-windows")
    n_windows = per_doc.agg(F.sum(F.size("at"))).first()[0] or 0
    later = join_hot(windows, repeated, "window", "times", n_windows).filter(F.col("place") != F.col("first"))
    covered = F.when(F.col("first.key") == F.col("key"), F.array_except("place.at", "first.at")).otherwise(F.col("place.at"))
    return (
        later.select("key", F.explode(covered).alias("number"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("number")).alias("drop"))
    )


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of ``text``; same columns and rows."""
    return without_lines(docs, repeated_lines(docs, doc_id, text), row_key(docs[f"`{doc_id}`"], docs[f"`{text}`"]), text)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")
    cut = line_dedup(docs)
    left = F.when(F.length("text") == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return cut.select("doc_id", "n_lines", left.alias("n_lines_left"), "text")


QUERIES = {"op9_line_dedup": op9_line_dedup}

ORACLE = {
    "op9_line_dedup": r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
k AS (SELECT row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS r, * FROM d),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM k),
ln AS (SELECT r, n, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw),
w AS (SELECT r, n AS n1, lead(n) OVER o AS n2, lead(n, 2) OVER o AS n3, norm AS a, lead(norm) OVER o AS b, lead(norm, 2) OVER o AS c
      FROM ln WHERE norm <> '' WINDOW o AS (PARTITION BY r ORDER BY n)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY r, n1) AS occ, first_value(r) OVER g AS fr,
             first_value([n1, n2, n3]) OVER g AS fn FROM w WHERE n3 IS NOT NULL WINDOW g AS (PARTITION BY a, b, c ORDER BY r, n1)),
cut AS (SELECT DISTINCT r, n FROM (SELECT r, fr, fn, unnest([n1, n2, n3]) AS n FROM f WHERE occ > 1) WHERE r <> fr OR NOT list_contains(fn, n)),
res AS (SELECT raw.r, count(*) AS n_lines, count(*) FILTER (cut.n IS NULL) AS kept_lines,
               coalesce(string_agg(raw.line, chr(10) ORDER BY raw.n) FILTER (cut.n IS NULL), '') AS text
        FROM raw LEFT JOIN cut ON raw.r = cut.r AND raw.n = cut.n GROUP BY raw.r)
SELECT x.doc_id, res.n_lines, CASE WHEN length(res.text) = 0 THEN 0 ELSE res.kept_lines END AS n_lines_left, res.text
FROM documents x JOIN k ON x.doc_id = k.doc_id AND x.text IS NOT DISTINCT FROM k.text JOIN res ON res.r = k.r"""
}
