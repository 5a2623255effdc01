"""Files that tasks read as streams: digests of any file, and the rows of zipped CSV files.

Both are Python data sources. The driver lists names and sizes only; files are dealt to
tasks by bytes, a large one alone, and a task holds one block or one chunk of rows, never a file.
Paths are folders of any file system that pyarrow opens from an address (local or
shared folders, HDFS, S3); files whose names start with ``_`` or ``.`` are not listed.
"""
from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 128 << 20
BLOCK, CHUNK_ROWS = 1 << 20, 50_000
DIGESTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; ``file:/x`` and ``/x`` name the same file."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def dealt(sizes: list[tuple[str, int]], task_bytes: int) -> list[Files]:
    """Files in order of their names, about ``task_bytes`` to a task."""
    out: list[Files] = []
    own: list[str] = []
    held = 0
    for path, size in sorted(sizes):
        if own and held + size > task_bytes:
            out.append(Files(tuple(own)))
            own, held = [], 0
        own.append(path)
        held += size
    return [*out, Files(tuple(own))] if own else out


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.address, self.suffix = options["path"], options.get("suffix", "")
        self.task_bytes, self.schema = int(options.get("task_bytes", TASK_BYTES)), schema

    def partitions(self) -> list[Files]:
        system, folder = opened(self.address)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        sizes = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_." and f.path.endswith(self.suffix)]
        return dealt(sizes, self.task_bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.address)
        for path in partition.paths:
            yield from self.batches(system, path)


class DigestReader(FolderReader):
    def batches(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        digest, size = hashlib.sha256(), 0
        with system.open_input_stream(path, compression=None) as stream:
            while block := stream.read(BLOCK):
                digest.update(block)
                size += len(block)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size], "sha256": [digest.hexdigest()]})


class ZippedCsvReader(FolderReader):
    def batches(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        names = [n for n in self.schema.names if n != "path"]
        with system.open_input_file(path) as file:
            try:
                archive = zipfile.ZipFile(file)
            except zipfile.BadZipFile as broken:
                raise ValueError(f"not a sound archive: {path}") from broken
            members = [m for m in archive.namelist() if m.endswith(".csv")]
            if len(members) != 1:
                raise ValueError(f"not an archive with one CSV: {path}")
            with archive.open(members[0]) as stream:  # the checksum is compared at its end
                for chunk in csv_chunks(stream, names):
                    columns = {n: pa.array(chunk[n], pa.string(), from_pandas=True) for n in names}
                    yield pa.RecordBatch.from_pydict({n: columns.get(n, pa.array([path] * len(chunk), pa.string())) for n in self.schema.names})


def csv_chunks(stream: io.BufferedIOBase, names: list[str]) -> Iterator[pd.DataFrame]:
    """The named columns as text, chunk by chunk; bytes that are not UTF-8 are replaced."""
    for chunk in pd.read_csv(stream, usecols=names, dtype=str, encoding_errors="replace", chunksize=CHUNK_ROWS):
        yield chunk[names].astype(object).where(chunk[names].notna(), None)


class FileDigests(DataSource):
    """(path, n_bytes, sha256) of every file of a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> T.StructType:
        return DIGESTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DigestReader(dict(self.options), schema)


class ZippedCsv(DataSource):
    """Rows of zip archives of one CSV member each: text columns as named by the schema, and ``path``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> T.StructType:
        raise ValueError("zipped_csv needs a schema of text columns")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if any(f.dataType != T.StringType() for f in schema):
            raise ValueError("zipped_csv reads text columns only")
        return ZippedCsvReader(dict(self.options), schema)


def load(spark: SparkSession, source: type[DataSource], folder: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.load(folder)
