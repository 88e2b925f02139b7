"""What several operators share: row keys, line hashes and line removal.

Row keys.  Spark may evaluate a scan more than once, so operators that come
back to a document identify it by content: a 128-bit hash of its id and text
(and host, where that matters).  Repeated rows share a key and get the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: ASCII white space, as `bytes.split()` and `[\x20\x09-\x0D]` have it.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def binary_text(column: Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")


def row_key(*columns: Column) -> Column:
    """128-bit content key of the given columns; nulls and empty strings differ."""
    parts = []
    for column in columns:
        parts += [F.when(column.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(column.cast("string"), F.lit("")), F.lit("\x1f")]
    return F.unhex(F.md5(F.concat(*parts)))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with ``df``'s columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Keys that a join may broadcast: each has more than the same share of all rows, so there are no more of them.
HOT_KEYS = 10_000


def is_hot(weight: str, n_rows: int) -> Column:
    """Whether a key with ``weight`` of ``n_rows`` rows has more than its share."""
    return F.col(weight) * HOT_KEYS > n_rows


def join_hot(rows: DataFrame, once: DataFrame, on: str | list[str], weight: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows.join(once, on, how)`` where ``once`` has one row a key and, in ``weight``, how many rows have it.

    ``n_rows`` is at least the sum of all weights.  A key with more than
    1/HOT_KEYS of it is hot: at most HOT_KEYS rows, which are broadcast, so hot
    rows stay where they are.  All others meet in a shuffle.
    """
    on = [on] if isinstance(on, str) else on
    mark = free_name(rows, "is_hot")
    hot = is_hot(weight, n_rows)
    marked = rows.join(F.broadcast(once.filter(hot).withColumn(mark, F.lit(True))), on, "left")
    direct = marked.filter(F.col(mark).isNotNull()).drop(mark)
    others = marked.filter(F.col(mark).isNull()).select(*rows.columns).join(once.filter(~hot), on, how)
    return direct.unionByName(others)


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrites the column `text` without the lines numbered in `drop`; other columns pass."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, numbers in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("drop")).to_pylist(), strict=True):
            if numbers and text is not None:
                gone = set(numbers)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def without_lines(docs: DataFrame, removals: DataFrame, key: Column, text: str = "text", how: str = "left") -> DataFrame:
    """``docs`` with numbered lines taken out of ``text``; ``removals`` has (key, drop array<int>).

    ``how="inner"`` also drops the documents without a row in ``removals``.

    The join is on a content key, one row a document on the removal side, so
    no key is hot.  Only the columns of ``docs`` are returned.
    """
    name = free_name(docs, "removal_key")
    keyed = docs.withColumn(name, key)
    joined = keyed.join(removals.select(F.col("key").alias(name), F.col("drop").alias(f"{name}_drop")), name, how).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"{name}_drop").alias("drop")
    )
    cut = joined.mapInArrow(drop_lines, joined.schema)
    return cut.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
