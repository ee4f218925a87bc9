"""Data sources for files that Spark has no reader for by itself: dashboard batches by number, and shards of arrays.

spark.read.format("dashboard_batches").load(folder) reads batch-<n>.json, a partition a file; filters on batch_id choose files
before any is opened. spark.read.format("array_shards").load(folder) reads <name>.npy matrices, a partition a stretch of rows; filters
on shard and row choose stretches, and a stretch is read from its own bytes. Filters reach the sources where
spark.sql.python.filterPushdown.enabled is true; without it they are applied afterwards, with the same result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from actlake.sources.schemas import BATCH

#: Rows of a matrix that one partition reads.
ROWS = 65_536
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TESTS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def _listed(folder: str, pattern: str) -> list[tuple[str, str]]:
    """Path and first group of the files of a folder whose names match, in order of the name."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    found = ((x.path, re.fullmatch(pattern, x.base_name)) for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    return sorted((p, m[1]) for p, m in found if m)


def _open(folder: str, path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)[0].open_input_file(path)


class _Choosing(DataSourceReader):
    """Keeps the filters on some columns; the others are left to Spark."""

    columns: tuple[str, ...] = ()

    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if (type(f) in _TESTS or isinstance(f, In)) and f.attribute[0] in self.columns and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def keeps(self, column: str, value) -> bool:
        """Whether a value of the column passes all filters on it."""
        return all((value in f.value if isinstance(f, In) else getattr(value, _TESTS[type(f)])(f.value) is True) for f in self.filters if f.attribute[0] == column)


@dataclass
class BatchFile(InputPartition):
    path: str
    batch_id: int


class BatchReader(_Choosing):
    columns = ("batch_id",)

    def partitions(self) -> list[BatchFile]:
        found = sorted((int(n), p) for p, n in _listed(self.folder, r"batch-(\d+)\.json"))
        if not found:
            raise FileNotFoundError(f"no batch-*.json in {self.folder}")
        return [BatchFile(p, n) for n, p in found if self.keeps("batch_id", n)] or [BatchFile("", -1)]

    def read(self, partition: BatchFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with _open(self.folder, partition.path) as f:
                row = json.loads(f.read()) | {"batch_id": partition.batch_id}
            yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(BatchFiles.SCHEMA))


class BatchFiles(DataSource):
    SCHEMA = T.StructType([*BATCH.fields, T.StructField("batch_id", T.IntegerType())])

    @classmethod
    def name(cls) -> str:
        return "dashboard_batches"

    def schema(self) -> T.StructType:
        return self.SCHEMA

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(self.options["path"])


@dataclass
class Stretch(InputPartition):
    path: str
    shard: str
    start: int
    stop: int


def _head(f) -> tuple[int, tuple[int, ...], np.dtype]:
    """Where the data of a .npy file begin, their shape and type."""
    version = np.lib.format.read_magic(f)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column or len(shape) != 2:
        raise ValueError("not a matrix by rows")
    return f.tell(), shape, kind


class ShardReader(_Choosing):
    columns = ("shard", "row")

    def partitions(self) -> list[Stretch]:
        out = []
        for path, shard in _listed(self.folder, r"(.+)\.npy"):
            if not self.keeps("shard", shard):
                continue
            with _open(self.folder, path) as f:
                _, (n, _), _ = _head(f)
            out += [Stretch(path, shard, a, min(a + ROWS, n)) for a in range(0, n, ROWS) if self._meets(a, min(a + ROWS, n))]
        return out or [Stretch("", "", 0, 0)]

    def _meets(self, start: int, stop: int) -> bool:
        """Whether any row of a stretch can pass."""
        for f in self.filters:
            if f.attribute[0] == "row":
                inside = isinstance(f, In) and any(start <= v < stop for v in f.value) or isinstance(f, EqualTo) and start <= f.value < stop
                low, high = isinstance(f, (GreaterThan, GreaterThanOrEqual)), isinstance(f, (LessThan, LessThanOrEqual))
                if not (inside or low and getattr(stop - 1, _TESTS[type(f)])(f.value) or high and getattr(start, _TESTS[type(f)])(f.value)):
                    return False
        return True

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(self.folder, partition.path) as f:
            at, (_, width), kind = _head(f)
            f.seek(at + partition.start * width * kind.itemsize)
            x = np.frombuffer(f.read((partition.stop - partition.start) * width * kind.itemsize), dtype=kind).reshape(-1, width).astype(np.float64)
        rows = np.arange(partition.start, partition.stop)
        keep = np.array([self.keeps("row", int(r)) for r in rows]) if any(f.attribute[0] == "row" for f in self.filters) else slice(None)
        rows, x = rows[keep], x[keep]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([partition.shard] * len(x), pa.string()), pa.array(rows), lists], names=["shard", "row", "x"])


class ArrayShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_shards"

    def schema(self) -> str:
        return "shard string, row long, x array<double>"

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets filters reach them."""
    for source in (BatchFiles, ArrayShards):
        spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")


def write_batch_files(features: DataFrame, head: dict[str, str], folder: str) -> list[str]:
    """One batch-<n>.json for each batch_id, written in the tasks, each whole or not at all; gives the names back.

    features: rows of the dashboard schema with batch_id. A batch is a bounded number of features.
    """
    rows = features.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in features.columns if c != "batch_id")))).alias("features"))
    texts = rows.select("batch_id", F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), "features")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"batch-{n}.json" for n in batch.column(0).to_pylist()]
            for name, text in zip(names, batch.column(1).to_pylist()):
                _put(folder, name, text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return sorted(r["name"] for r in texts.mapInArrow(write, "name string").collect())


def write_shards(rows: DataFrame, by: str, column: str, folder: str) -> list[str]:
    """One .npy matrix for each value of `by` (a short name or number), rows in order of `row`, written in the tasks; gives the shards back.

    rows: by, row (long, from 0 without gaps in each shard) and the column of arrays of one length. A shard is held by one
    task, so shards are to be of bounded size.
    """

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("row")
        x, shard = np.stack(part.column("x").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float32), str(part.column("by")[0].as_py())
        out = pa.BufferOutputStream()
        np.lib.format.write_array(out, x, version=(1, 0))
        _put(folder, f"{shard}.npy", out.getvalue().to_pybytes())
        return pa.table({"shard": [shard]})

    dealt = rows.select(F.col(by).alias("by"), "row", F.col(column).alias("x"))
    return sorted(r["shard"] for r in dealt.groupBy("by").applyInArrow(write, "shard string").collect())


def _put(folder: str, name: str, content: bytes) -> None:
    """A file that is there whole or not at all; a repeated task writes it again."""
    import uuid

    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(own) as out:
        out.write(content)
    files.move(own, f"{path}/{name}")

