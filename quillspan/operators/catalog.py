"""Tables, views and functions of a session, with a log of what changed.

A table is a list of Parquet files in the shared root.  Files are never
changed: INSERT adds files, and UPDATE, DELETE and MERGE first look which files
hold a row that they hit and write only those anew.  The name then points at
the new list, so readers of the old version are not disturbed and a failed
write leaves the table as it was.  ``expire`` deletes files that only old
versions have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators import changes
from quillspan.sources.scratch import discard, new_folder
from quillspan.sources.tables import wildcard_table

#: The column of file names while hits are looked for.
_FILE = "name of the file"


class Catalog:
    """Names are paths such as ``project.dataset.table``; a prefix completes shorter ones."""

    def __init__(self, spark: SparkSession, name_path: tuple[str, ...] = ()):
        self.spark, self.name_path = spark, name_path
        self._paths: dict[str, tuple[list[str], T.StructType]] = {}
        self._retired: list[str] = []
        self._views: dict[str, Callable[[], DataFrame]] = {}
        self._functions: dict[str, Callable[..., Column]] = {}
        self._temporary: set[str] = set()
        self.log: list[tuple[str, str, str]] = []

    def _full(self, name: str) -> str:
        parts = tuple(name.split("."))
        return ".".join(self.name_path[: max(0, len(self.name_path) + 1 - len(parts))] + parts)

    def set_name_path(self, *name_path: str) -> None:
        """Shorter names are completed by this path from here on."""
        self.name_path = name_path

    def add_name_path(self, part: str) -> None:
        self.name_path = (*self.name_path, part)

    def exists(self, name: str) -> bool:
        return self._full(name) in self._paths or self._full(name) in self._views

    def table(self, name: str) -> DataFrame:
        full = self._full(name)
        if full in self._views:
            return self._views[full]()
        if full not in self._paths:
            raise KeyError(f"no table {full}")
        return self._read(*self._paths[full])

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def wildcard(self, prefix: str, suffixes: set[str] | None = None) -> DataFrame:
        full = self._full(prefix)
        return wildcard_table({n: self.table(n) for n in self._paths if n.startswith(full)}, full, suffixes)

    def _store(self, full: str, rows: DataFrame, schema: T.StructType, stay: list[str]) -> None:
        """The table is the files ``stay`` and the new rows from here on."""
        path = new_folder(self.spark, "table")
        rows.select(*[rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
        self._point(full, stay + self.spark.read.schema(schema).parquet(path).inputFiles(), schema)

    def _point(self, full: str, files: list[str], schema: T.StructType) -> None:
        before, _ = self._paths.get(full, ([], schema))
        self._retired += sorted(set(before) - set(files))
        self._paths[full] = (files, schema)

    def create(self, name: str, definition: DataFrame | str | T.StructType, or_replace: bool = False, if_not_exists: bool = False, temporary: bool = False, columns: list[str] | None = None) -> None:
        """CREATE TABLE with a schema, or AS SELECT with a DataFrame, whose columns get the names of ``columns`` in turn."""
        full = self._full(name)
        if full in self._paths and not or_replace:
            if if_not_exists:
                return
            raise ValueError(f"table {full} exists")
        rows = definition if isinstance(definition, DataFrame) else self.spark.createDataFrame([], definition)
        rows = rows if columns is None else rows.toDF(*columns)
        kind = "updated" if full in self._paths else "added"
        self._store(full, rows, rows.schema, [])
        if temporary:
            self._temporary.add(full)
        self.log.append(("table", kind, full))

    def create_view(self, name: str, query: Callable[[], DataFrame], or_replace: bool = False, if_not_exists: bool = False) -> None:
        full = self._full(name)
        if full in self._views and not or_replace:
            if if_not_exists:
                return
            raise ValueError(f"view {full} exists")
        self._views[full] = query
        self.log.append(("view", "added", full))

    def create_function(self, name: str, body: Callable[..., Column]) -> None:
        """A SQL function is an expression of its arguments; types are resolved where it is called."""
        self._functions[name] = body
        self.log.append(("function", "added", name))

    def call(self, name: str, *arguments: Column) -> Column:
        return self._functions[name](*arguments)

    def drop(self, name: str, if_exists: bool = False) -> None:
        full = self._full(name)
        if full not in self._paths and full not in self._views:
            if if_exists:
                return
            raise KeyError(f"no table {full}")
        kind = "table" if full in self._paths else "view"
        files, _ = self._paths.pop(full, ([], None))
        self._retired += files
        self._views.pop(full, None)
        self.log.append((kind, "deleted", full))

    def drop_function(self, name: str, if_exists: bool = False) -> None:
        if name not in self._functions:
            if if_exists:
                return
            raise KeyError(f"no function {name}")
        del self._functions[name]
        self.log.append(("function", "deleted", name))

    def close(self) -> None:
        """Drops temporary tables."""
        for full in sorted(self._temporary & set(self._paths)):
            self.drop(full)

    def expire(self) -> int:
        """Deletes the files that no table has any more, and returns their number; readers of old versions must be done."""
        retired, self._retired = self._retired, []
        for file in retired:
            discard(self.spark, file)
        return len(retired)

    def _rewrite(self, name: str, hits: Callable[[DataFrame], DataFrame] | None, change: Callable[[DataFrame], DataFrame]) -> None:
        """``change`` on the files that have a row of ``hits``; on all where that is None."""
        full = self._full(name)
        files, schema = self._paths[full]
        touched = files
        if hits is not None and files:
            marked = self._read(files, schema).select("*", F.col("_metadata.file_name").alias(_FILE))
            # one row a file
            hit = {row[0] for row in hits(marked).select(_FILE).distinct().collect()}
            touched = [f for f in files if f.rsplit("/", 1)[1] in hit]
        self._store(full, change(self._read(touched, schema)), schema, [f for f in files if f not in set(touched)])
        self.log.append(("table", "updated", full))

    def insert(self, name: str, rows: DataFrame) -> None:
        full = self._full(name)
        files, schema = self._paths[full]
        self._store(full, changes.insert(self.spark.createDataFrame([], schema), rows), schema, files)
        self.log.append(("table", "updated", full))

    def update(self, name: str, assignments: dict[str, Column], where: Column) -> None:
        self._rewrite(name, lambda t: t.filter(where), lambda t: changes.update(t, assignments, where))

    def delete(self, name: str, where: Column) -> None:
        self._rewrite(name, lambda t: t.filter(where), lambda t: changes.delete(t, where))

    def truncate(self, name: str) -> None:
        full = self._full(name)
        self._point(full, [], self._paths[full][1])
        self.log.append(("table", "updated", full))

    def merge(self, name: str, source: DataFrame, key: str, clauses: list[changes.When]) -> None:
        """Files without a matched row stay, unless a clause is about rows that the source lacks."""
        every = any(clause.kind == "not_matched_by_source" for clause in clauses)
        matched = lambda t: t.join(source.select(key), key, "left_semi")
        self._rewrite(name, None if every else matched, lambda t: changes.merge(t, source, key, clauses))
