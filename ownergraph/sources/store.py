"""Tables that change together: versioned folders and numbered manifests.

A load writes its tables into a folder of its own, which nobody reads yet. Then one
small file, the next manifest, names the folder of every table; it appears by a
rename. Readers follow the manifest of the highest number. A load that fails leaves
the manifest, and so all tables, counts and load records, as they were; two loads
that start from the same manifest can't both succeed (``StoreConflict``).

    <store>/v-<id>/<table>          Parquet files of one load
    <store>/_manifests/<n>.json     table -> path, schema, row counts; the rest of
                                    the tables is taken over from manifest n - 1
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"


class StoreConflict(RuntimeError):
    """Another load has replaced tables since this one began."""


class NoSuchTable(LookupError):
    """The store's current manifest does not name the table."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of files and folders (patterns too); 0 for what does not exist."""
    total = 0
    for name in paths:
        path, fs = _path(spark, name)
        for status in fs.globStatus(path) or []:
            total += fs.getContentSummary(status.getPath()).getLength()
    return total


def _number(spark: SparkSession, store: str) -> int:
    """Number of the current manifest, 0 before the first."""
    folder, fs = _path(spark, f"{store.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(folder):
        return 0
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)


def manifest(spark: SparkSession, store: str, number: int | None = None) -> dict:
    """The current manifest (or that of ``number``): table name -> entry."""
    number = _number(spark, store) if number is None else number
    if not number:
        return {}
    path, fs = _path(spark, f"{store.rstrip('/')}/{MANIFESTS}/{number:012d}.json")
    stream = fs.open(path)
    try:
        size = fs.getFileStatus(path).getLen()
        text = bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()
    return json.loads(text)


class Load:
    """One load into a store: write tables to ``folder(name)``, ``add`` them, then
    ``publish`` all at once. Nothing is seen before that."""

    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = spark, store.rstrip("/")
        self.base = _number(spark, self.store)
        self.version = f"v-{uuid.uuid4().hex}"
        self.entries: dict[str, dict] = {}
        self.left_out: set[str] = set()

    def folder(self, name: str) -> str:
        return f"{self.store}/{self.version}/{name}"

    def add(self, name: str, schema: T.StructType, below: str | None = None, **facts) -> None:
        """Name a table that was written to ``folder(name)``, or to ``below`` that
        the load's own folder holds."""
        relative = f"{self.version}/{below or name}"
        self.entries[name] = {"path": relative, "schema": json.loads(schema.json()), **facts}
        path, fs = _path(self.spark, f"{self.store}/{relative}")
        fs.mkdirs(path)  # a table without rows has no files

    def leave_out(self, *names: str) -> None:
        """Tables that the new manifest does not take over from the old one."""
        self.left_out.update(names)

    def read(self, name: str) -> DataFrame:
        """A table of this load, before it is published."""
        return _read(self.spark, self.store, self.entries[name])

    def publish(self) -> int:
        """Make the added tables current; the number of the new manifest."""
        number = self.base + 1
        claim, fs = _path(self.spark, f"{self.store}/{MANIFESTS}/{number:012d}.claim")
        if _number(self.spark, self.store) != self.base:
            raise StoreConflict(f"{self.store} has changed since the load began")
        try:
            fs.create(claim, False).close()  # one load gets the number
        except Py4JJavaError as error:
            raise StoreConflict(f"another load is publishing to {self.store}") from error
        before = manifest(self.spark, self.store, self.base)
        tables = {**{name: entry for name, entry in before.items() if name not in self.left_out}, **self.entries}
        draft, _ = _path(self.spark, f"{self.store}/{MANIFESTS}/{number:012d}.draft")
        final, _ = _path(self.spark, f"{self.store}/{MANIFESTS}/{number:012d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(tables, indent=1).encode()))
        finally:
            out.close()
        if not fs.rename(draft, final):
            raise StoreConflict(f"can't publish manifest {number} of {self.store}")
        return number


def _read(spark: SparkSession, store: str, entry: dict) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    return spark.read.schema(schema).parquet(f"{store.rstrip('/')}/{entry['path']}")


def exists(spark: SparkSession, store: str, name: str) -> bool:
    return name in manifest(spark, store)


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The current table ``name`` of a store."""
    tables = manifest(spark, store)
    if name not in tables:
        raise NoSuchTable(f"{store} has no table {name}")
    return _read(spark, store, tables[name])
