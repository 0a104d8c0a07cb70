"""Rows of a shelf of Parquet files by their numbers, as a table or as a stream: slices of a split without reading what precedes them.

A shelf is what a dataset's hub serves: files of splits, with their row counts. The driver knows counts only; each task opens the
files of its own range of rows and reads the row groups that hold them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from millrace.sources.configs import split_bounds
from millrace.sources.files import parquet_files

NAME = "rowshelf"


class Shelf:
    """A split's Parquet files in order, and the number of the first row of each. path is a folder or a URI that Arrow can open.
    A task that reads a piece opens that piece's file only."""

    def __init__(self, path: str, split: str, config: str | None = None) -> None:
        self.store, self.root = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        self.split, self.config = split, config

    @cached_property
    def files(self) -> list[str]:
        top = self.root.rstrip("/") + "/"
        there = self.store.get_file_info(pa.fs.FileSelector(self.root, recursive=True))
        return [top + f for f in parquet_files([f.path.removeprefix(top) for f in there if f.is_file], self.split, self.config)]

    @cached_property
    def ends(self) -> list[int]:
        return list(accumulate(self._open(f).metadata.num_rows for f in self.files))

    def _open(self, file: str) -> pq.ParquetFile:
        return pq.ParquetFile(file, filesystem=self.store)

    @property
    def size(self) -> int:
        return self.ends[-1]

    @property
    def schema(self) -> pa.Schema:
        return self._open(self.files[0]).schema_arrow

    def pieces(self, start: int, stop: int, most: int) -> Iterator[Piece]:
        """Rows start to stop, each piece of one file and of at most so many rows."""
        while start < min(stop, self.size):
            k = bisect.bisect_right(self.ends, start)
            first = self.ends[k] - (self.ends[k] - self.ends[k - 1] if k else self.ends[0])
            end = min(stop, self.ends[k], start + most)
            yield Piece(self.files[k], start - first, end - first)
            start = end

    def read(self, piece: Piece, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """A piece's rows from the row groups that hold them."""
        file, at = self._open(piece.file), 0
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            low, high = max(piece.start - at, 0), min(piece.stop - at, n)
            if low < high:
                before = 0
                for batch in file.iter_batches(4096, row_groups=[group], columns=list(columns)):
                    a, b = max(low - before, 0), min(high - before, batch.num_rows)
                    if a < b:
                        yield batch.slice(a, b - a).select(list(columns))
                    before += batch.num_rows
            at += n


@dataclass(frozen=True)
class Piece(InputPartition):
    file: str
    start: int
    stop: int


class _Rows:
    """What both readers share. Options: path, split (a name, with an optional slice), config, task_rows."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.path = schema.fieldNames(), options["path"]
        self.split, self.config = options.get("split", "train"), options.get("config")
        self.start, self.stop = split_bounds(self.split)
        self.most = int(options.get("task_rows", 100_000))

    def shelf(self) -> Shelf:
        return Shelf(self.path, self.split.partition("[")[0], self.config)

    def end(self) -> int:
        return max(self.start, min(self.shelf().size, self.stop if self.stop is not None else 1 << 62))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.shelf().read(partition, self.columns)


class _TableReader(_Rows, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return list(self.shelf().pieces(self.start, self.end(), self.most)) or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.stop:
            yield from super().read(partition)


class _StreamReader(_Rows, DataSourceStreamReader):
    """Offsets are row numbers of the split. Files that sort behind those read so far are new rows; a batch has all that are there."""

    def initialOffset(self) -> dict:
        return {"row": self.start}

    def latestOffset(self) -> dict:
        return {"row": self.end()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return list(self.shelf().pieces(start["row"], end["row"], self.most))

    def commit(self, end: dict) -> None:
        pass


class RowShelf(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return from_arrow_schema(_Rows(StructType(), self.options).shelf().schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def shelf_rows(spark: SparkSession, path: str, split: str = "train", streaming: bool = False, config: str | None = None, task_rows: int = 100_000) -> DataFrame:
    """The rows of a split, or of its slice as in train[100:900], as a table or a stream. Row numbers count the split's files
    in the order of their names. A split without a file is an error; a slice beyond the rows is empty."""
    spark.dataSource.register(RowShelf)
    reader = (spark.readStream if streaming else spark.read).format(NAME).options(path=path, split=split, task_rows=task_rows)
    return (reader.option("config", config) if config else reader).load()
