"""Dense matrices as a data source of Spark: files of two 64-bit counts (rows, columns) and 32-bit floats.

    matrices.register(spark)
    spark.read.format("dense_matrix").load(path)      # file, row, weights; path is a file or a folder
    df.select("weights").write.format("dense_matrix").save(path)
    spark.readStream.format("dense_matrix").load(path)  # files that come into a folder

Reads are planned as ranges of rows, which tasks find by their byte offsets; the options fromRow and toRow (exclusive) leave out the rest of
each file. They are options and no pushed filters because Spark 4.1 keeps a Python reader with the filters of the first query of a frame,
and later queries of that frame would lack rows. Files are reached by pyarrow's file systems. A file whose length is not what its header
says is an error.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

HEADER = struct.Struct("<qq")
#: Rows that a task reads if the option rowsPerTask does not say so, and rows of an Arrow batch.
ROWS_PER_TASK, BATCH = 100_000, 1000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_in(path: str) -> list[str]:
    """The matrix files at a path, by name; hidden ones are left out."""
    system, at = opened(path)
    if system.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = system.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def shape(path: str, file: str) -> tuple[int, int]:
    """Rows and columns that a file's header tells and its length confirms."""
    system, _ = opened(path)
    length = system.get_file_info(file).size
    with system.open_input_file(file) as f:
        head = f.read(HEADER.size)
    rows, columns = HEADER.unpack(head) if len(head) == HEADER.size else (-1, -1)
    if rows < 0 or columns < 0 or length != HEADER.size + 4 * rows * columns:
        raise ValueError(f"{file} is no matrix")
    return rows, columns


@dataclass
class Rows(InputPartition):
    """A range of a file's rows."""

    file: str
    columns: int
    low: int
    high: int


def planned(path: str, files: list[str], per_task: int, low: int = 0, high: int | None = None) -> list[Rows]:
    out = []
    for file in files:
        rows, columns = shape(path, file)
        last = rows if high is None else min(rows, high)
        out += [Rows(file, columns, at, min(at + per_task, last)) for at in range(max(0, low), last, per_task)]
    return out


def rows_of(path: str, part: Rows) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    name = posixpath.basename(part.file)
    with system.open_input_file(part.file) as f:
        for at in range(part.low, part.high, BATCH):
            n = min(BATCH, part.high - at)
            f.seek(HEADER.size + 4 * part.columns * at)
            values = pa.array(np.frombuffer(f.read(4 * part.columns * n), "<f4"), pa.float32())
            weights = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.columns, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), weights], names=["file", "row", "weights"])


class Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int, low: int, high: int | None):
        self.path, self.per_task, self.low, self.high = path, per_task, low, high

    def partitions(self) -> list[Rows]:
        return planned(self.path, files_in(self.path), self.per_task, self.low, self.high)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Files in the order of their names; an offset is the last name that was read."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((posixpath.basename(f) for f in files_in(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return planned(self.path, [f for f in files_in(self.path) if start["last"] < posixpath.basename(f) <= end["last"]], self.per_task)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Wrote(WriterCommitMessage):
    files: tuple[str, ...]


class Writer(DataSourceArrowWriter):
    """Each task writes files of at most so many rows under hidden names; they get their own when all tasks are done."""

    def __init__(self, path: str, per_file: int, overwrite: bool):
        self.path, self.per_file, self.overwrite = path, per_file, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        files, held, rows, columns = [], [], 0, None
        task = uuid.uuid4().hex

        def put() -> None:
            nonlocal held, rows
            name = f"part-{len(files):05d}-{task}.bin"
            with system.open_output_stream(f"{folder}/.{name}") as f:
                f.write(HEADER.pack(rows, columns))
                for part in held:
                    f.write(part)
            files.append(name)
            held, rows = [], 0

        for batch in iterator:
            for at in range(0, batch.num_rows, BATCH):
                weights = batch.column("weights").slice(at, BATCH)
                sizes = set(weights.value_lengths().to_pylist())
                columns = columns if columns is not None else next(iter(sizes))
                if sizes != {columns} or weights.flatten().null_count:
                    raise ValueError("all rows of a matrix need as many numbers")
                held.append(weights.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                rows += len(weights)
                if rows >= self.per_file:
                    put()
        if rows:
            put()
        return Wrote(tuple(files))

    def commit(self, messages: list[Wrote | None]) -> None:
        system, folder = opened(self.path)
        if self.overwrite:
            for file in files_in(self.path):
                system.delete_file(file)
        for name in [n for m in messages if m for n in m.files]:
            system.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list[Wrote | None]) -> None:
        system, folder = opened(self.path)
        for name in [n for m in messages if m for n in m.files]:
            system.delete_file(f"{folder}/.{name}")


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense_matrix"

    def schema(self) -> str:
        return "file string, row long, weights array<float>"

    def per_task(self) -> int:
        return int(self.options.get("rowsPerTask", ROWS_PER_TASK))

    def reader(self, schema) -> Reader:
        last = self.options.get("toRow")
        return Reader(self.options["path"], self.per_task(), int(self.options.get("fromRow", 0)), int(last) if last else None)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], self.per_task())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.per_task(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)


def dense_matrix(spark: SparkSession, path: str, columns: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """file, row, weights; an error if the rows have not as many numbers as asked for."""
    register(spark)
    if columns is not None and any(shape(path, f)[1] != columns for f in files_in(path)):
        raise ValueError(f"not a matrix of {columns} columns")
    return spark.read.format("dense_matrix").option("rowsPerTask", rows_per_task).load(path)
