"""``vectors_f32``: files of little-endian float32 vectors, without a header, as a Spark data source.

A file is cut into byte ranges of whole records, each a task that reads its
range and hands the bytes on as Arrow. Row ids are the records' places, in a
folder through its files in order of name. Options: ``path``, ``dim``
(components of a vector) and ``rows`` (records of a task at most).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

#: Schemes that pyarrow opens, each with its name there.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Bytes of a task's range, and of an Arrow batch.
RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme not in SCHEMES:
        raise ValueError(f"vectors_f32 cannot open {scheme}: paths")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def _files(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file, or the folder's files in order of name; none if nothing is there."""
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return []
    if info.is_file:
        return [info]
    found = files.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


@dataclass
class Range(InputPartition):
    """``rows`` records of a file from its record ``first``, which is the row ``row_id``."""

    path: str
    first: int
    rows: int
    row_id: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, dim: int, rows: int):
        self.path, self.dim, self.rows = path, dim, rows

    def partitions(self) -> list[Range]:
        ranges, row_id, record = [], 0, 4 * self.dim
        files, path = located(self.path)
        for file in _files(files, path):
            if file.size % record:
                raise ValueError(f"{file.path}: {file.size} bytes are no whole number of records of {record}")
            for first in range(0, file.size // record, self.rows):
                rows = min(self.rows, file.size // record - first)
                ranges.append(Range(file.path, first, rows, row_id + first))
            row_id += file.size // record
        return ranges

    def read(self, partition: Range | None):
        if partition is None:  # no file, or empty ones
            return
        files, _ = located(self.path)
        step = max(1, BATCH_BYTES // (4 * self.dim))
        with files.open_input_file(partition.path) as file:
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                data = file.read_at(4 * self.dim * n, 4 * self.dim * (partition.first + at))
                values = pa.array(np.frombuffer(data, "<f4", n * self.dim))
                lists = pa.ListArray.from_arrays(np.arange(0, n * self.dim + 1, self.dim, dtype=np.int32), values)
                ids = pa.array(np.arange(n) + partition.row_id + at)
                yield pa.RecordBatch.from_arrays([ids, lists], ["row_id", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    task: int
    name: str


class _Writer(DataSourceArrowWriter):
    """A file of each task's rows under a name that readers pass over, named anew when all are there."""

    def __init__(self, path: str, dim: int, overwrite: bool):
        self.path, self.dim, self.overwrite = path, dim, overwrite

    def write(self, iterator) -> _Written:
        files, path = located(self.path)
        files.create_dir(path, recursive=True)
        name = f"_{uuid.uuid4().hex}"
        with files.open_output_stream(f"{path}/{name}") as out:
            for batch in iterator:
                lists = batch.column(batch.schema.get_field_index("embedding"))
                values = lists.flatten()
                if lists.null_count or values.null_count or (np.diff(lists.offsets.to_numpy()) != self.dim).any():
                    raise ValueError(f"a vector has not {self.dim} components")
                out.write(values.to_numpy().astype("<f4").tobytes())
        return _Written(TaskContext.get().partitionId(), name)

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = located(self.path)
        there = _files(files, path)
        start = 0 if self.overwrite or not there else 1 + max(int(f.base_name[5:15]) for f in there)
        for file in there if self.overwrite else []:
            files.delete_file(file.path)
        for m in messages:
            if m is not None:
                files.move(f"{path}/{m.name}", f"{path}/part-{start + m.task:010d}.f32")

    def abort(self, messages: list[_Written | None]) -> None:
        files, path = located(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{path}/{m.name}")


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors_f32"

    def schema(self) -> str:
        return "row_id long, embedding array<float>"

    def _dim(self) -> int:
        return int(self.options["dim"])

    def reader(self, schema) -> DataSourceReader:
        rows = self.options.get("rows") or max(1, RANGE_BYTES // (4 * self._dim()))
        return _Reader(self.options["path"], self._dim(), int(rows))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._dim(), overwrite)


def _opens(path: str) -> bool:
    scheme, colon, _ = path.partition(":")
    return not colon or "/" in scheme or scheme in SCHEMES


def read_vectors_f32(spark: SparkSession, path: str, dim: int, rows: int | None = None) -> DataFrame:
    """(row_id, embedding) of a file of little-endian float32, ``dim`` to a record, or of a folder of such files.

    A size that is no multiple of the record fails; what is missing or empty
    gives no rows. ``rows`` is the number of records of a task at most (128 MB
    by default). Paths of schemes that only Hadoop opens are read through it.
    """
    if not _opens(path):
        return _through_hadoop(spark, path, dim)
    spark.dataSource.register(VectorFiles)
    reader = spark.read.format("vectors_f32").option("dim", dim)
    return (reader.option("rows", rows) if rows else reader).load(path)


def write_vectors_f32(vectors: DataFrame, path: str, dim: int, mode: str = "append", vector: str = "embedding") -> None:
    """Write vectors as files under ``path`` in the order of the DataFrame's partitions and rows.

    Sort before, if row ids are to follow an order. A null vector, a null
    component or another length than ``dim`` fails and leaves nothing that a
    reader sees. Two writers at a time of one folder are not kept apart: that
    is what ``VectorStore`` is for.
    """
    vectors.sparkSession.dataSource.register(VectorFiles)
    rows = vectors.selectExpr("CAST(NULL AS BIGINT) AS row_id", f"CAST(`{vector}` AS ARRAY<FLOAT>) AS embedding")
    rows.write.format("vectors_f32").option("dim", dim).mode(mode).save(path)


def _through_hadoop(spark: SparkSession, path: str, dim: int) -> DataFrame:
    schema = "row_id long, embedding array<float>"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex()
    return spark.createDataFrame(rows.map(lambda r: (r[1], np.frombuffer(r[0], "<f4").tolist())), schema)
