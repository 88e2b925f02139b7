"""Operator 8, exact deduplication: groups of equal normalised texts.

Texts are equal when they are identical after every run of ASCII white space
became one space.  Rows are grouped by a 128-bit content hash together with
the normalised bytes themselves, so the aggregation compares bytes inside a
hash group and a collision cannot merge two texts.  The grouping is combined
on the map side: thousands of copies leave a task as one row.  The text is
shuffled once, for the groups; documents find their group over two digests.

Only DataFrame functions run here.

Defined cases: null text counts as empty; the kept document is the one with
the smallest non-null id, and a group of null ids keeps null; repeated rows
with the kept id are all marked kept, since they are one document; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), normalised(docs[f"`{text}`"]).alias("norm")).select(
        "doc_id", "norm", F.unhex(F.md5("norm")).alias("h128")
    )
    groups = (
        hashed.groupBy("h128", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.col("h128").alias("group_h128"), F.sha2("norm", 256).alias("group_sha256"), "keep_id", "group_size")
    )
    members = hashed.select("doc_id", "h128", F.sha2("norm", 256).alias("text_sha256"))
    same = (F.col("h128") == F.col("group_h128")) & (F.col("text_sha256") == F.col("group_sha256"))
    return members.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLE = {
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
}
