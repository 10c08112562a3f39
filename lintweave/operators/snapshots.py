"""Stored relations as versions: several tables are replaced, cleared, upserted or added to in one step.

A version is a small manifest that names each table's folders of Parquet; folders are never changed once a version names
them. A change writes its folders first and then one manifest, under the next number, by a rename that fails if that number
is taken: readers see the old version or the new one, a writer that dies leaves the old one, and of two writers that began
from the same version the second fails. Folders that no version names are removed by vacuum.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import store


class Conflict(Exception):
    """Another writer committed first."""


class Snapshots:
    """The versions under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path(f"{self.root}/versions")[1].mkdirs(self._path(f"{self.root}/versions")[0])

    def _path(self, at: str):
        path = self._fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all versions, ascending."""
        path, fs = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        """0 before the first change."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Tables of a version: their folders and schema."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        path, fs = self._path(f"{self.root}/versions/v{version:08}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in entry["folders"]))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the latest by default."""
        known = self.manifest(version)
        if table not in known:
            raise KeyError(f"no table {table} in this version")
        return self._read(known[table])

    def change(self) -> Change:
        """Begins from the latest version; use as a context, which commits at its end."""
        return Change(self)

    def _commit(self, base: int, tables: dict[str, dict]) -> int:
        """Makes version base + 1."""
        text = json.dumps(tables, sort_keys=True)
        aside, fs = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final = self._path(f"{self.root}/versions/v{base + 1:08}.json")[0]
        sc = self.spark.sparkContext
        options = sc._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)
        except Exception as x:
            fs.delete(aside, False)
            if fs.exists(final):
                raise Conflict(f"version {base + 1} is there already") from x
            raise
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions and the folders that none of those names; returns how many folders went.

        Not while a change is under way: its folders aren't named yet.
        """
        numbers = self.versions()
        kept = numbers[-keep:]
        named = {x for v in kept for entry in self.manifest(v).values() for x in entry["folders"]}
        for v in numbers[: -len(kept)] if kept else []:
            path, fs = self._path(f"{self.root}/versions/v{v:08}.json")
            fs.delete(path, False)
        gone = 0
        data, fs = self._path(f"{self.root}/data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            if f"data/{status.getPath().getName()}" not in named:
                gone += fs.delete(status.getPath(), True)
        return gone


class Change:
    """Writes of one step; nothing is visible before the end of the context, and nothing ever if it fails."""

    def __init__(self, of: Snapshots):
        self.of, self.base = of, of.latest()
        self.tables = of.manifest(self.base)
        self.version: int | None = None

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.version = self.of._commit(self.base, self.tables)

    def read(self, table: str) -> DataFrame:
        """A table as this change leaves it so far."""
        return self.of._read(self.tables[table])

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.of.root}/{folder}")
        return folder

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows go, these come; in the columns and types that the table has, if there is one."""
        if table in self.tables:
            rows = store.replace(self.read(table), rows)
        self.tables[table] = {"folders": [self._written(rows)], "schema": json.loads(rows.schema.json())}

    def clear(self, *tables: str) -> None:
        """All rows of these tables go, of all tables if none is named; columns stay."""
        for x in tables or tuple(self.tables):
            self.tables[x] = {"folders": [], "schema": self.tables[x]["schema"]}

    def add(self, table: str, rows: DataFrame) -> None:
        """Rows come to those that are there."""
        if table not in self.tables:
            return self.replace(table, rows)
        entry = self.tables[table]
        self.tables[table] = {"folders": [*entry["folders"], self._written(store.replace(self.read(table), rows))], "schema": entry["schema"]}

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Rows replace those with the same key."""
        self.replace(table, store.upsert(self.read(table), rows, keys, order))

    def ignore(self, table: str, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        """Rows with new keys come, others don't."""
        self.replace(table, store.insert_ignore(self.read(table), rows, keys, order))

    def scoped(self, table: str, rows: DataFrame, scope: Column, keys: list[str]) -> None:
        """Rows in the scope go, then rows are upserted."""
        self.replace(table, store.scoped_replace(self.read(table), rows, scope, keys))
