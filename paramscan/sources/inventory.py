"""File inventories: a Python data source that walks directory trees, and digests of what it lists.

``spark.read.format("file_inventory").option("root", dir).load()`` lists one
row per regular file, with paths relative to the root. Top-level directories
are split over tasks. Symbolic links and store directories are left out, but,
unlike Spark's own file sources, names with a leading ``_`` or ``.`` are kept.
An equality or ``LIKE`` filter is not pushed; a ``pattern`` option is, as a
regex on the relative path.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import STORE_DIRS

CHUNK = 1 << 20
SCHEMA = "path string, size bigint, mtime double"


def walk(root: str, below: str = "") -> Iterator[tuple[str, os.stat_result]]:
    """Regular files below ``root/below``: relative path and status."""
    todo = [below]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                if e.is_symlink() or e.name.lower() in STORE_DIRS:
                    continue
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir():
                    todo.append(path)
                elif e.is_file():
                    yield path, e.stat()


class Piece(InputPartition):
    def __init__(self, folders: list[str], files: bool):
        self.folders, self.files = folders, files


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(os.path.expanduser(options["root"]))
        self.pattern = options.get("pattern")
        self.tasks = int(options.get("tasks", "64"))
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"{self.root} does not exist")
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"{self.root} is not a directory")

    def partitions(self) -> list[Piece]:
        with os.scandir(self.root) as entries:
            folders = sorted(e.name for e in entries if e.is_dir() and not e.is_symlink() and e.name.lower() not in STORE_DIRS)
        return [Piece([], True), *(Piece(folders[n :: self.tasks], False) for n in range(min(self.tasks, len(folders))))]

    def read(self, piece: Piece) -> Iterator[tuple]:
        keep = re.compile(self.pattern).match if self.pattern else None
        if piece.files:
            with os.scandir(self.root) as entries:
                found = [(e.name, e.stat()) for e in entries if e.is_file() and not e.is_symlink()]
        else:
            found = (x for folder in piece.folders for x in walk(self.root, folder))
        for path, status in found:
            if keep is None or keep(path):
                yield path, status.st_size, status.st_mtime


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(dict(self.options))


def inventory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below ``root``: ``(path, size, mtime)``; ``pattern`` is a Python regex that paths match from their start."""
    spark.dataSource.register(InventorySource)
    reader = spark.read.format("file_inventory").option("root", root)
    return (reader.option("pattern", pattern) if pattern else reader).load()


def file_digest(path: str, algorithm: str = "sha1") -> str:
    found = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            found.update(chunk)
    return found.hexdigest()


def with_checksum(files: DataFrame, root: str, algorithm: str = "sha1", path: str = "path", out: str = "sha1") -> DataFrame:
    """Add the digest of each distinct file, streamed in chunks on the executors; null where there is no such regular file."""

    def hashed(batches):
        for pdf in batches:
            def one(p):
                full = os.path.join(root, p)
                return file_digest(full, algorithm) if os.path.isfile(full) and not os.path.islink(full) else None

            yield pdf.assign(**{"_digest": [one(p) for p in pdf["_path"]]})

    unique = files.select(F.col(path).alias("_path")).distinct()
    digests = unique.mapInPandas(hashed, "_path string, _digest string")
    return files.join(digests, F.col(path) == F.col("_path"), "left").drop("_path").withColumnRenamed("_digest", out)
