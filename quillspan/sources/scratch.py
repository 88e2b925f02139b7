"""Work tables in the folder that the driver and all executors share.

Iterative and multi-pass operators cut their lineage by writing Parquet under
``spark.checkpoint.dir``.  The written table outlives a lost executor, is
column-pruned when read, and never sits on one machine's own disk.

All work tables of an application lie in one folder, which goes when its JVM
ends.  ``work_tables`` deletes the tables made inside it earlier, once their
result has been read, and ``discard`` a single one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables made since the innermost ``work_tables`` was entered, innermost last.
_SCOPES: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master, where all is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="spark-quillspan-")
    return _OWN["root"]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new work table; nothing is created yet."""
    own = f"{shared_root(spark)}/quillspan/{spark.sparkContext.applicationId}"
    if _OWN.get("marked") != own:
        files, place = _hadoop(spark, own)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _OWN["marked"] = own
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work table; nothing may read it any more."""
    files, place = _hadoop(spark, path)
    files.delete(place, True)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the work tables made inside; results must have been written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def keep_at(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a work table at ``path`` and return a reader over it with the same schema."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a work table and return a reader over it with the same schema."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if partition_by is None:
        return keep_at(df, path)
    df.write.option("compression", "zstd").partitionBy(partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """A work table dealt by the column ``by`` as a shuffle would, so grouping by it moves no row again."""
    spark = df.sparkSession
    table = f"quillspan_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, name))
    writer.bucketBy(buckets, by).saveAsTable(table)
    kept = spark.table(table).select(*df.columns)
    # the frame has its files; only the catalog's entry goes
    spark.sql(f"DROP TABLE {table}")
    return kept
