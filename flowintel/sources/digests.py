"""Data source that digests files in chunks: spark.read.format("file_digest").

The driver lists the files; each partition holds one large file or some small ones, up to
`partition_bytes`.  A task streams its files through SHA-256, `chunk_bytes` at a time, so memory does
not depend on the size of a file.  Stores are reached by pyarrow (local paths, file:, hdfs:, s3:, gs:, abfs:).

Options: `paths` (JSON list of files and folders), `base` (folder the names are relative to; by
default the one folder given, else the first path's parent), `chunk_bytes`, `partition_bytes`, `larger_than` (only files
of more bytes and empty ones, each read by hashlib.file_digest() instead of in chunks: a second way for comparisons).
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 1 << 20
PARTITION_BYTES = 128 << 20

# workers get these classes by value, so they need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Files(InputPartition):
    """(path or URI given, path in its store, relative name, size) of the files of one task."""
    files: list[tuple[str, str, str, int]]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and its path there."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))


def listed(paths: list[str], base: str | None) -> list[tuple[str, str, str, int]]:
    """(path or URI given, path in its store, name, size) of the files given and of those below the folders given.

    In folders, names that begin with a dot or an underscore are left out.  A name is relative to
    `base`, or just the file's own where it lies elsewhere.
    """
    found = []
    for uri in paths:
        store, path = located(uri.rstrip("/"))
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        files = [info]
        if info.type == fs.FileType.Directory:
            files = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True))
                     if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        root = base or (path if info.type == fs.FileType.Directory and len(paths) == 1 else None)
        base = base or root or posixpath.dirname(path)
        top = located(base.rstrip("/"))[1].rstrip("/") + "/"
        found += [(uri, f.path, f.path.removeprefix(top) if f.path.startswith(top) else f.base_name, f.size) for f in files]
    return found


class DigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.base = json.loads(options["paths"]), options.get("base")
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.larger_than = int(options["larger_than"]) if "larger_than" in options else None

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        room = 0
        for file in listed(self.paths, self.base):
            if self.larger_than is not None and 0 < file[-1] <= self.larger_than:
                continue
            if not out or file[-1] > room:
                out.append(Files([]))
                room = self.most
            out[-1].files.append(file)
            room -= file[-1]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str, int]]:
        for uri, path, name, _ in partition.files:
            store, _ = located(uri.rstrip("/"))
            if self.larger_than is not None:
                with store.open_input_file(path) as opened:
                    yield name, hashlib.file_digest(opened, "sha256").hexdigest(), opened.tell()
                continue
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(path, compression=None, buffer_size=0) as stream:
                while chunk := stream.read(self.chunk):
                    digest.update(chunk)
                    size += len(chunk)
            yield name, digest.hexdigest(), size


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digest"

    def schema(self) -> str:
        return "path string, sha256 string, size_bytes bigint"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def file_digests(
    spark: SparkSession, paths: str | list[str], base: str | None = None, chunk_bytes: int = CHUNK_BYTES,
    partition_bytes: int = PARTITION_BYTES, larger_than: int | None = None,
) -> DataFrame:
    """path (relative), sha256, size_bytes of the files at or below `paths`; where `larger_than` is given, of larger and empty ones."""
    spark.dataSource.register(FileDigests)
    reader = spark.read.format("file_digest").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    reader = reader.option("chunk_bytes", chunk_bytes).option("partition_bytes", partition_bytes)
    reader = reader if larger_than is None else reader.option("larger_than", larger_than)
    return (reader.option("base", base) if base else reader).load()
