"""Operator 1, quality rules: cross-document line frequency.

Every document gets the base statistics of its whole text.  The method's own
verdict comes from lines that many documents of one host share: normalised
lines are hashed to 128 bits, distinct documents are counted per host and
line, lines above the limit are removed, and a document of which too little
is left is rejected as depleted.

A line is over the limit in a host when more than ``max(min_docs, share *
documents of the host)`` distinct documents of the host have it.  Documents
are distinct by text, so a thousand exact copies count once and are left to
the deduplication operators.  ``clean`` counts by near-copy component
(operator 10) instead, so a group of near copies counts once as well and its
common lines do not deplete every member.

Defined cases: null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows get equal results; lines
without a word are neither counted nor removed; a line twice in a document
counts once for it; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import ngrams
from quillspan.llm.common import ASCII_SPACE, binary_text, is_hot, join_hot, row_key, without_lines
from quillspan.sources.scratch import keep

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = "key binary, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash binary, line_hashes array<binary>, line_words array<int>, line_numbers array<int>"
_ARROW = pa.schema(
    [("key", pa.binary()), ("doc_id", pa.int64()), ("host", pa.string())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("text_hash", pa.binary()), ("line_hashes", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int32())), ("line_numbers", pa.list_(pa.int32()))]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def measure(text: bytes) -> tuple:
    """Base statistics of a text, and hash, words and number of each line that has a word."""
    words = text.split()
    seen: set[bytes] = set()
    duplicates, hashes, sizes, numbers = 0, [], [], []
    for number, line in enumerate(text.split(b"\n")):
        own = line.split()
        if own:
            duplicates += line in seen
            seen.add(line)
            hashes.append(xxhash.xxh3_128_digest(b" ".join(own).lower()))
            sizes.append(len(own))
            numbers.append(number)
    characters = len(text.translate(None, ASCII_SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), characters, symbols, duplicates, repeated_words(words), xxhash.xxh3_128_digest(text), hashes, sizes, numbers


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            rows = [measure(text) for text in part.column(3).to_pylist()]
            columns = list(zip(*rows, strict=True))
            arrays = [part.column(0), part.column(1), part.column(2)]
            arrays += [pa.array(list(c), _ARROW.field(3 + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _ARROW, strict=True)], schema=_ARROW)


def _key(docs: DataFrame, doc_id: str, host: str, text: str):
    return row_key(docs[f"`{doc_id}`"], docs[f"`{host}`"], docs[f"`{text}`"])


def line_frequency(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = 10,
    share: float = 0.05,
    min_left: float = 0.3,
    min_words: int = 50,
    classes: DataFrame | None = None,
) -> DataFrame:
    """Statistics, boilerplate line numbers and verdict of every document.

    Columns: key, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_shared_lines, shared_words, drop, kept.
    ``classes`` (key, copy_class), one row a key, makes documents distinct by
    class instead of by text.

    The text is read once: what the counts need is written as a narrow work
    table.  Hot lines (in a third of all documents) are pre-aggregated before
    the shuffle that counts them.  In the join that brings the lines over the
    limit back to their documents, a hot line's rows stay where they are.
    """
    narrow = docs.select(
        _key(docs, doc_id, host, text).alias("key"),
        docs[f"`{doc_id}`"].cast("long").alias("doc_id"),
        # never null, so that a null host is a host like others in every join
        F.coalesce(F.concat(F.lit("="), docs[f"`{host}`"].cast("string")), F.lit("")).alias("host"),
        binary_text(docs[f"`{text}`"]).alias("text"),
    )
    base = keep(narrow.mapInArrow(_measure_batches, MEASURES), "quality")

    once = F.first("line_hashes").alias("line_hashes"), F.count("*").alias("copies")
    if classes is None:
        distinct = base.groupBy("host", "text_hash").agg(*once)
        lines_of = distinct.select("host", F.explode(F.array_distinct("line_hashes")).alias("line"), "copies")
        documents = base.select("host", "text_hash").distinct()
    else:
        of_class = base.join(classes, "key").select("host", "copy_class", "text_hash", "line_hashes")
        distinct = of_class.groupBy("host", "copy_class", "text_hash").agg(*once)
        of_texts = distinct.select("host", "copy_class", F.explode(F.array_distinct("line_hashes")).alias("line"), "copies")
        lines_of = of_texts.groupBy("host", "copy_class", "line").agg(F.sum("copies").alias("copies"))
        documents = of_class.select("host", "copy_class").distinct()
    counts = lines_of.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("weight"))
    hosts = documents.groupBy("host").agg(F.count("*").alias("host_docs"))
    n_lines = base.agg(F.sum(F.size("line_words"))).first()[0] or 0
    is_over = (F.col("n_docs") > min_docs) & (F.col("n_docs") > F.lit(share) * F.col("host_docs"))
    # hot lines within the limit are there too, so that their rows do not meet in one task for nothing
    judged = counts.filter((F.col("n_docs") > min_docs) | is_hot("weight", n_lines)).join(hosts, "host").withColumn("is_over", is_over)
    judged = keep(judged.filter(F.col("is_over") | is_hot("weight", n_lines)).select("host", "line", "weight", "is_over"), "judged-lines")
    lines = base.select("key", "host", F.explode(F.arrays_zip("line_hashes", "line_words", "line_numbers")).alias("l")).select(
        "key", "host", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words"), F.col("l.line_numbers").alias("number")
    )
    hits = (
        join_hot(lines, judged, ["host", "line"], "weight", n_lines)
        .filter("is_over")
        .groupBy("key")
        .agg(F.collect_set(F.struct("number", "words")).alias("hits"))
        .select(
            "key",
            F.array_sort(F.col("hits.number")).alias("drop"),
            F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["words"].cast("long")).alias("shared_words"),
        )
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        base.select("key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        .join(hits, "key", "left")
        .withColumn("shared_words", F.coalesce("shared_words", F.lit(0).cast("long")))
        .withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
        .withColumn("n_shared_lines", F.size("drop").cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("shared_words")) >= round(100 * min_left) * F.col("n_words")))
    )


def copy_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, copy_class): the near-copy component of each document, found by content, so ids may be null or repeated."""
    found = ngrams.jaccard_components(docs, doc_id, text).select(F.col("key").alias("copy_key"), F.coalesce("component", F.xxhash64("key")).alias("copy_class"))
    copies = row_key(docs[f"`{doc_id}`"], docs[f"`{text}`"])
    keys = docs.select(_key(docs, doc_id, host, text).alias("key"), copies.alias("copy_key")).distinct()
    return keys.join(keep(found.distinct(), "copy-classes"), "copy_key").select("key", "copy_class")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` without rejected documents, and without shared lines in those that stay; same columns."""
    verdicts = line_frequency(docs, doc_id, text, host, classes=copy_classes(docs, doc_id, text, host), **limits)
    kept = verdicts.filter("kept").groupBy("key").agg(F.first("drop").alias("drop"))
    key = _key(docs, doc_id, host, text)
    return without_lines(docs, kept, key, text, how="inner")


def op1_line_frequency(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_frequency(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_shared_lines", "shared_words"
    )


QUERIES = {"op1_line_frequency": op1_line_frequency}

ORACLE = {
    "op1_line_frequency": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
ln AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
lw AS (SELECT *, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lws FROM ln),
l AS (SELECT *, translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
             row_number() OVER (PARTITION BY r, raw ORDER BY n) AS k FROM lw WHERE len(lws) > 0),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
lim AS (SELECT c.host, c.norm FROM (SELECT host, norm, count(DISTINCT t) AS n_docs FROM l GROUP BY 1, 2) c JOIN hosts h ON c.host IS NOT DISTINCT FROM h.host
        WHERE n_docs > 10 AND n_docs > 0.05 * host_docs),
hit AS (SELECT l.r, count(*) AS n_shared_lines, sum(len(lws)) AS shared_words FROM l JOIN lim ON l.host IS NOT DISTINCT FROM lim.host AND l.norm = lim.norm GROUP BY 1),
dup AS (SELECT r, count(*) FILTER (k > 1) AS n_dup_lines FROM l GROUP BY 1),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY 1),
a AS (SELECT w.r, w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_shared_lines, 0) AS n_shared_lines, coalesce(shared_words, 0) AS shared_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN hit USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - shared_words) >= 30 * n_words AS kept,
       CAST(n_shared_lines AS BIGINT) AS n_shared_lines, CAST(shared_words AS BIGINT) AS shared_words FROM b"""
}
