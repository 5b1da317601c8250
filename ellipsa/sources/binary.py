"""Spark data sources of the binary vector and class files.

``vecbin``: (row_id long, features array<float>); ``clsbin``: (row_id long, cluster int), which files number from 1 and tables from 0.

    spark.dataSource.register(VecBin)
    spark.read.format("vecbin").option("start", 1000).option("rows", 500).load(path)
    df.orderBy("row_id").write.format("vecbin").mode("overwrite").save(folder)

A reading task takes a byte range; nothing but headers is read on the driver. A row's id is its place in the file or, in a folder of
part files, in the folder. A writing task writes one part with a header of its own. Once all have ended, the list of the folder's parts is
replaced, which is when the new table takes the place of the old one; then what the list doesn't name is deleted: older parts and what lost or
repeated tasks have left. One writer at a time may write a folder. ``join_parts`` makes one file of a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import INT_MAX, FormatError, header_bytes, listed, located, parts_of, write_list

#: Bytes of one reading task, and of one batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    offset: int
    rows: int
    cols: int
    first_id: int


def balanced(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, rows) of each part; the first ones are a row larger."""
    base, more = divmod(n, parts)
    return [(i * base + min(i, more), base + (i < more)) for i in range(parts)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, vectors: bool):
        self.path, self.vectors = options["path"], vectors
        self.start = max(0, int(options.get("start", 0)))
        self.most = int(options.get("rows", 1 << 62))
        self.tasks = int(options.get("partitions", 0))

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for p in parts_of(self.path, self.vectors):
            low, high = max(self.start - before, 0), min(self.start + self.most - before, p.rows)
            if high > low:
                width = 4 * p.cols
                for at, n in balanced(high - low, max(1, self.tasks or -(-(high - low) * width // TASK_BYTES))):
                    if n:
                        out.append(Range(p.path, p.offset + (low + at) * width, n, p.cols, before + low + at))
            before += p.rows
        return out or [Range("", 0, 0, 1, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        system, _ = located(self.path)
        width = 4 * partition.cols
        step, done = max(1, BATCH_BYTES // width), 0
        with system.open_input_file(partition.path) as f:
            f.seek(partition.offset)
            while done < partition.rows:
                n = min(step, partition.rows - done)
                data = f.read(n * width)
                if len(data) != n * width:
                    raise FormatError(f"{partition.path}: ends early")
                ids = pa.array(np.arange(partition.first_id + done, partition.first_id + done + n))
                if self.vectors:
                    ends = pa.array(np.arange(0, (n + 1) * partition.cols, partition.cols, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(data, "<f4")))], ["row_id", "features"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(data, "<i4") - 1)], ["row_id", "cluster"])
                done += n


@dataclass
class Written(WriterCommitMessage):
    name: str
    task: int
    rows: int


class _Writer(DataSourceArrowWriter):
    """Rows go out as they come in: sort the table by row_id first, which gives ascending ranges to ascending tasks."""

    def __init__(self, options: dict, vectors: bool, overwrite: bool):
        self.path, self.vectors, self.overwrite = options["path"], vectors, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get().partitionId()
        name = f"{folder}/part-{task:010d}-{uuid.uuid4().hex}"
        rows, cols = 0, None
        # the number of rows is known at the end, and stores can't write backwards: the records wait in a part of their own
        with system.open_output_stream(f"{name}.body") as out:
            for batch in iterator:
                if batch.num_rows:
                    values, cols = self._values(batch, cols)
                    out.write(values.tobytes())
                    rows += batch.num_rows
        if rows:
            with system.open_output_stream(name) as out, system.open_input_stream(f"{name}.body") as body:
                out.write(header_bytes(rows, (cols or 1) if self.vectors else None))
                while data := body.read(BATCH_BYTES):
                    out.write(data)
        system.delete_file(f"{name}.body")
        return Written(name if rows else "", task, rows)

    def _values(self, batch: pa.RecordBatch, cols: int | None) -> tuple[np.ndarray, int | None]:
        column = batch.column(batch.schema.get_field_index("features" if self.vectors else "cluster"))
        if column.null_count:
            raise FormatError("a row without a value can't be written")
        if not self.vectors:
            return column.to_numpy(zero_copy_only=False).astype("<i4") + 1, None
        flat = column.flatten()
        widths = set(column.value_lengths().to_pylist()) | ({cols} if cols else set())
        if len(widths) > 1 or 0 in widths or flat.null_count:
            raise FormatError("vectors must be of one length, not empty and without nulls")
        return flat.to_numpy(zero_copy_only=False).astype("<f4"), widths.pop()

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        if not self.overwrite and listed(system, folder):
            self.abort(messages)
            raise FileExistsError(self.path)
        names = [m.name.rpartition("/")[2] for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.task)]
        write_list(system, folder, names)
        for info in system.get_file_info(FileSelector(folder)):
            if info.base_name.startswith("part-") and info.base_name not in names:
                system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            if m and m.rows:
                system.delete_file(m.name)


class VecBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return "row_id long, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, True, overwrite)


class ClsBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clsbin"

    def schema(self) -> str:
        return "row_id long, cluster int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, False, overwrite)


def _load(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**options).load(path)


def read_vectors(spark: SparkSession, path: str, start: int = 0, rows: int | None = None, partitions: int = 0) -> DataFrame:
    """row_id and features of a file or folder, or of a range of its rows."""
    return _load(spark, VecBin, path, start=start, partitions=partitions, **({} if rows is None else {"rows": rows}))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, ClsBin, path)


def write_vectors(df: DataFrame, path: str) -> None:
    """The vectors in order of row_id, as single precision, to a folder of parts; an older table there is replaced."""
    df.sparkSession.dataSource.register(VecBin)
    df.selectExpr("cast(row_id as long) row_id", "cast(features as array<float>) features").orderBy("row_id").write.format("vecbin").mode("overwrite").save(path)


def write_classes(df: DataFrame, path: str) -> None:
    """The clusters in order of row_id to a folder of parts."""
    df.sparkSession.dataSource.register(ClsBin)
    df.selectExpr("cast(row_id as long) row_id", "cast(cluster as int) cluster").orderBy("row_id").write.format("clsbin").mode("overwrite").save(path)


def query_header(path: str, vectors: bool = True) -> tuple[int, int]:
    """(rows, columns) from headers alone."""
    parts = parts_of(path, vectors)
    return sum(p.rows for p in parts), max((p.cols for p in parts), default=0)


def join_parts(folder: str, path: str, vectors: bool = True) -> None:
    """One file of a folder's parts, streamed; memory doesn't grow with it."""
    source, _ = located(folder)
    target, name = located(path)
    parts = parts_of(folder, vectors)
    rows, cols = sum(p.rows for p in parts), max((p.cols for p in parts), default=1)
    with target.open_output_stream(name) as out:
        out.write(header_bytes(rows, cols if vectors else None, rows > INT_MAX))
        for p in parts:
            with source.open_input_file(p.path) as f:
                f.seek(p.offset)
                while data := f.read(BATCH_BYTES):
                    out.write(data)
