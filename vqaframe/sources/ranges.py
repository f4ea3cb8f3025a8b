"""Byte ranges of files as a Spark data source, on any file system that ``pyarrow.fs`` can open.

``byte_ranges`` gives one row per range of a file, each range its own task, so that a file larger than a task should
hold is read by many. Files named by a URI (``s3://``, ``hdfs://``, ``file:``) or a plain path open by themselves;
others through ``filesystem``, any picklable ``pyarrow.fs.FileSystem``.
"""

from __future__ import annotations

import base64
import json
import pickle

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vqaframe.session import ship_package


def pack_filesystem(filesystem: pafs.FileSystem | None) -> str:
    return "" if filesystem is None else base64.b64encode(pickle.dumps(filesystem)).decode()


def locate(path: str, packed: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a file."""
    if packed:
        return pickle.loads(base64.b64decode(packed)), path
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class _Range(InputPartition):
    def __init__(self, path: str, chunk: int, offset: int, size: int):
        self.path, self.chunk, self.offset, self.size = path, chunk, offset, size


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size, self.packed = json.loads(options["paths"]), int(options["rangebytes"]), options["filesystem"]

    def partitions(self):
        out = []
        for path in self.paths:
            filesystem, inside = locate(path, self.packed)
            length = filesystem.get_file_info(inside).size
            if length is None:
                raise FileNotFoundError(path)
            out += [_Range(path, k, at, min(self.size, length - at)) for k, at in enumerate(range(0, max(1, length), self.size))]
        return out

    def read(self, part):
        filesystem, inside = locate(part.path, self.packed)
        with filesystem.open_input_file(inside) as f:
            data = f.read_at(part.size, part.offset)
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.chunk], pa.int32()), pa.array([data], pa.binary())],
                                         ["path", "chunk", "data"])


class ByteRangeSource(DataSource):
    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "path string, chunk int, data binary"

    def reader(self, schema):
        return ByteRangeReader(self.options)


def byte_ranges(spark: SparkSession, paths: list[str], range_bytes: int = 32 * 1024 * 1024,
                filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """(path, chunk, data): the ranges of the files, numbered from 0 in each."""
    ship_package(spark)
    spark.dataSource.register(ByteRangeSource)
    return (spark.read.format("byte_ranges").option("paths", json.dumps(paths)).option("rangebytes", str(range_bytes))
            .option("filesystem", pack_filesystem(filesystem)).load())
