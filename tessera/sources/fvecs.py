"""Data source for .fvecs and .ivecs files: records of a 32-bit dimension and that many 4-byte values.

All records of a file have the first one's dimension; reading stops at a record of another dimension, at
dimension 0, and at a cut-off record. Files are read in ranges of records, so one file feeds many tasks.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 16 << 20


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, dimension: int):
        super().__init__(path)
        self.path, self.first, self.count, self.dimension = path, first, count, dimension


def estimate(path: str) -> tuple[int, int]:
    """Dimension of the first record and the number of whole records that the file's size allows."""
    size = os.path.getsize(path)
    if size < 4:
        return 0, 0
    with open(path, "rb") as f:
        n = int(np.frombuffer(f.read(4), "<u4")[0])
    return (n, size // (4 + 4 * n)) if n else (0, 0)


class VecsReader(DataSourceReader):
    kind = "<f4"

    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        out = []
        for path in self.paths:
            n, total = estimate(path)
            each = max(1, RANGE_BYTES // (4 + 4 * n))
            out += [Range(path, at, min(each, total - at), n) for at in range(0, total, each)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        width = 1 + partition.dimension
        with open(partition.path, "rb") as f:
            if partition.first:  # a record of another dimension before this range ends the file there
                heads = np.memmap(partition.path, "<u4", "r", shape=(partition.first, width))[:, 0]
                if np.any(heads != partition.dimension):
                    return
            f.seek(partition.first * width * 4)
            rows = np.frombuffer(f.read(partition.count * width * 4), "<u4").reshape(-1, width)
        bad = np.flatnonzero(rows[:, 0] != partition.dimension)
        rows = rows[: bad[0]] if len(bad) else rows
        if not len(rows):
            return
        values = np.ascontiguousarray(rows[:, 1:]).view(self.kind).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * partition.dimension, pa.int32()), pa.array(values))
        index = pa.array(np.arange(partition.first, partition.first + len(rows)))
        yield pa.RecordBatch.from_arrays([index, lists], names=["index", "vector"])


class IvecsReader(VecsReader):
    kind = "<i4"


def _paths(options: dict) -> list[str]:
    path = options["path"]
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith((".fvecs", ".ivecs")))
    return [path]


class FvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "index long, vector array<float>"

    def reader(self, schema):
        return VecsReader(_paths(self.options))


class IvecsSource(FvecsSource):
    @classmethod
    def name(cls):
        return "ivecs"

    def schema(self):
        return "index long, vector array<int>"

    def reader(self, schema):
        return IvecsReader(_paths(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def load(spark: SparkSession, path: str, prefix: str = "vec", limit: int = 0) -> DataFrame:
    """key (`prefix_index`), vector of a file; the first `limit` records, 0 for all."""
    register(spark)
    rows = spark.read.format("fvecs").load(path)
    if limit:
        rows = rows.where(F.col("index") < limit)
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.col("index").cast("string")).alias("key"), "vector")


def write(path: str, vectors) -> None:
    """Writes one file of vectors (rows of numbers), for tests and exchange of small sets."""
    rows = np.asarray(vectors, dtype="<f4")
    out = np.empty((len(rows), 1 + rows.shape[1]), dtype="<u4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = rows.view("<u4")
    out.tofile(path)
