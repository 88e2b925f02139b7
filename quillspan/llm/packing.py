"""Operator 6, conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` words; pieces go into bins of
that capacity, longest first.  Bins are kept in the order of their residual
room and carry two bitmaps, of the sources and of the duplicate clusters they
hold.  A piece takes the tightest bin that fits and has neither its source nor
its cluster: the search starts at the first residual that fits and goes on to
the next larger one until a compatible bin is found, or opens a new bin.

Best fit is sequential by nature, so pieces are dealt into shards of about
``SHARD_PIECES`` by hash and each shard is packed by one task with bounded
memory.  A hot source or cluster spreads over all shards; each shard leaves at
most a few half-full bins.

Defined cases: null or empty text has no words and gets a row without a bin;
a null source conflicts with nothing; repeated rows are one cluster, so they
never share a bin; equal lengths are packed by id, then piece; a null id comes
last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import binary_text
from quillspan.sources.scratch import keep

SHARD_PIECES = 8192
SIZES = "doc_id long, source string, n_words long, cluster long"
PLACED = "doc_id long, piece int, n_words long, bin_id long, bin_offset long, source string, cluster long"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, clusters = [], []
        for text, cluster in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            words = text.as_py().split()
            n.append(len(words))
            clusters.append(cluster if cluster is not None else xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(clusters, pa.int64())], names=["doc_id", "source", "n_words", "cluster"])


def _bits(values: list) -> list[int]:
    """One bit for each value that occurs more than once; others cannot conflict and get none."""
    times = Counter(v for v in values if v is not None)
    bit = {v: 1 << i for i, v in enumerate(v for v, n in times.items() if n > 1)}
    return [bit.get(v, 0) for v in values]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces must come longest first."""
    source_bits, cluster_bits = _bits(sources), _bits(clusters)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    by_residual: list[tuple[int, int]] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, source_bits, cluster_bits, strict=True):
        at = bisect_left(by_residual, (length, -1))
        while at < len(by_residual):
            chosen = by_residual[at][1]
            if not (held_sources[chosen] & source or held_clusters[chosen] & cluster):
                break
            at += 1
        if at < len(by_residual):
            residual, chosen = by_residual.pop(at)
        else:
            residual, chosen = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[chosen] |= source
        held_clusters[chosen] |= cluster
        bins.append(chosen)
        offsets.append(capacity - residual)
        if residual > length:
            insort(by_residual, (residual - length, chosen))
    return bins, offsets


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, n_words, bin_id, bin_offset, source, cluster: one row a piece.

    ``cluster`` names a column of duplicate clusters (whole numbers), such as
    the components of operator 10; where it is missing or null, documents with
    the same words are a cluster.
    """
    given = F.lit(None) if cluster is None else docs[f"`{cluster}`"]
    narrow = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{source}`"].cast("string").alias("source"), binary_text(docs[f"`{text}`"]).alias("text"), given.cast("long").alias("cluster"))
    sized = keep(narrow.mapInArrow(_sizes, SIZES), "sizes")
    n_pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_words") / capacity))
    pieces = sized.select("doc_id", "source", "cluster", "n_words", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece")).withColumn(
        "n_words", F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("piece") * F.lit(capacity).cast("long"))
    )
    total = sized.agg(F.sum(n_pieces)).first()[0] or 0
    shards = max(1, -(-total // SHARD_PIECES))

    def pack_shard(table: pa.Table) -> pa.Table:
        # nulls last: an id of null sorts behind all others; content decides between several of them, so a repeated task packs alike
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        shard = table.column("shard")[0].as_py()
        bins, offsets = best_fit(*(table.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity)
        return pa.table(
            {
                **{c: table.column(c) for c in ("doc_id", "piece", "n_words")},
                "bin_id": pa.array([(shard << 32) + b for b in bins], pa.int64()),
                "bin_offset": pa.array(offsets, pa.int64()),
                **{c: table.column(c) for c in ("source", "cluster")},
            }
        )

    dealt = pieces.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)).cast("long"))
    packed = dealt.groupBy("shard").applyInArrow(pack_shard, PLACED)
    none = F.lit(None).cast("long")
    empty = pieces.filter("n_words = 0").select("doc_id", "piece", "n_words", none.alias("bin_id"), none.alias("bin_offset"), "source", "cluster")
    return packed.unionByName(empty)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE: dict[str, str] = {}
