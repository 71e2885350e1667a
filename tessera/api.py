"""The store's client interface over tables of op-logs and vectors.

A Store keeps its data under a folder as Parquet: `log` (operations, appended a file per batch) and
`vectors` (the same for vectors). Every write is one job commit; reads see all commits.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError, invalid
from tessera.functions import vectors as V
from tessera.operators import kv, knn, metrics, oplog

_LOG = "seq long, op string, key string, value string"
_VECTORS = "seq long, op string, key string, vector array<float>"


class Vector:
    """A vector of 32-bit floats for callers."""

    def __init__(self, values: Sequence[float]):
        self.data = np.asarray(values, dtype=np.float32)

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i):
        return float(self.data[i])

    def __setitem__(self, i, value) -> None:
        self.data[i] = value

    def __eq__(self, other) -> bool:
        return isinstance(other, Vector) and np.array_equal(self.data, other.data)

    def to_list(self) -> list[float]:
        return self.data.tolist()

    def to_numpy(self) -> np.ndarray:
        return self.data

    def dot_product(self, other: Vector) -> float:
        self._same(other)
        return float(self.data.astype(float) @ other.data.astype(float))

    def magnitude(self) -> float:
        return math.sqrt(self.dot_product(self))

    def normalize(self) -> Vector:
        m = self.magnitude()
        return Vector(self.data / m) if m else Vector(self.data)

    def cosine_similarity(self, other: Vector) -> float:
        norm = self.magnitude() * other.magnitude()
        return self.dot_product(other) / norm if norm else 0.0

    def euclidean_distance(self, other: Vector) -> float:
        self._same(other)
        return float(np.linalg.norm(self.data.astype(float) - other.data.astype(float)))

    def _same(self, other: Vector) -> None:
        if len(self) != len(other):
            raise invalid("vectors differ in dimension")


class Store:
    def __init__(self, spark: SparkSession, path: str, dimension: int = 128, metric: str = "cosine"):
        self.spark, self.path, self.dimension, self.metric = spark, path.rstrip("/"), dimension, V.parse_metric(metric)
        self._batch: list[tuple[str, str, str | None]] | None = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.end_batch()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def log(self) -> DataFrame:
        return self._read("log", _LOG)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        at = self._read(name, schema).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
        self.spark.createDataFrame([(at + 1 + i, *row) for i, row in enumerate(rows)], schema).write.mode("append").parquet(f"{self.path}/{name}")

    # entries

    def entries(self) -> DataFrame:
        return oplog.current_state(self.log())

    def put(self, key: str, value: str) -> None:
        self.write([("put", key, value)])

    def delete(self, key: str) -> None:
        """Deletes a key, and its vector; a missing one is no error."""
        self.write([("delete", key, None)])
        if self.get_vector(key) is not None:
            self._append("vectors", _VECTORS, [("delete", key, None)])

    def write(self, ops: Sequence[tuple[str, str, str | None]]) -> None:
        """Operations in order; the last one on a key counts. One commit, or part of the open batch."""
        if any(op not in ("put", "delete") for op, _, _ in ops):
            raise invalid("an operation is put or delete")
        if self._batch is not None:
            self._batch += ops
        elif ops:
            self._append("log", _LOG, list(ops))

    def batch_put(self, items: Mapping[str, str]) -> None:
        self.write([("put", k, v) for k, v in items.items()])

    def begin_batch(self) -> None:
        """Opens a batch; within one it does nothing."""
        self._batch = [] if self._batch is None else self._batch

    def in_batch(self) -> bool:
        return self._batch is not None

    def end_batch(self) -> None:
        """Commits the open batch; without one it does nothing."""
        ops, self._batch = self._batch, None
        if ops:
            self._append("log", _LOG, ops)

    def get(self, key: str) -> str | None:
        row = oplog.current_state(self.log().where(F.col("key") == key)).first()
        return row["value"] if row else None

    def batch_get(self, keys: Sequence[str]) -> dict[str, str | None]:
        return {r["key"]: r["value"] for r in kv.batch_get(self.entries(), keys).collect()}

    def scan(self, start: str, end: str, limit: int = 0, reverse: bool = False, keys_only: bool = False) -> DataFrame:
        return kv.scan(self.entries(), start, end, reverse, limit, keys_only)

    def clear(self) -> None:
        rows = oplog.clear(self.log())
        rows.write.mode("append").parquet(f"{self.path}/log")

    # vectors

    def all_vectors(self) -> DataFrame:
        rows = self._read("vectors", _VECTORS).withColumnRenamed("vector", "value")
        return oplog.current_state(rows).withColumnRenamed("value", "vector")

    def put_vector(self, key: str, values: Sequence[float]) -> None:
        self.batch_put_vectors({key: values})

    def batch_put_vectors(self, items: Mapping[str, Sequence[float]]) -> None:
        rows = [("put", k, [float(x) for x in v]) for k, v in items.items()]
        if any(len(v) != self.dimension for _, _, v in rows):
            raise invalid(f"vectors must have dimension {self.dimension}")
        if rows:
            self._append("vectors", _VECTORS, rows)

    def get_vector(self, key: str) -> Vector | None:
        row = self.all_vectors().where(F.col("key") == key).first()
        return Vector(row["vector"]) if row else None

    def batch_get_vectors(self, keys: Sequence[str]) -> dict[str, Vector | None]:
        held = self.all_vectors().withColumnRenamed("vector", "value")
        return {r["key"]: Vector(r["value"]) if r["value"] is not None else None for r in kv.batch_get(held, keys).collect()}

    def search_similar(self, query: Sequence[float] | Vector, k: int = 10, metric: str | None = None, include_vectors: bool = False) -> DataFrame:
        values = query.to_list() if isinstance(query, Vector) else query
        return knn.knn(self.all_vectors(), values, k, metric or self.metric, include_vectors=include_vectors)

    def vector_stats(self) -> DataFrame:
        return knn.vector_stats(self.all_vectors(), self.metric)

    # operation

    def stats(self) -> dict:
        row = oplog.counts(self.log()).first()
        return {"total_entries": row["n_live"], "total_puts": row["n_puts"], "total_deletes": row["n_deletes"]}

    def health(self) -> str:
        rows = self.spark.createDataFrame([("database", True), ("storage", True)], "name string, ok boolean")
        return metrics.health(rows).first()["status"]

    def prometheus_text(self) -> str:
        singles = self.spark.createDataFrame([(f"tessera_{k}", "gauge", float(v)) for k, v in self.stats().items()], "name string, type string, value double")
        return "\n".join(r["line"] for r in metrics.prometheus_lines(singles).orderBy("name", "part", "le").collect()) + "\n"

    def execute(self, sql: str) -> DataFrame:
        """SQL over the views `entries` and `vectors`."""
        self.entries().createOrReplaceTempView("entries")
        self.all_vectors().createOrReplaceTempView("vectors")
        try:
            return self.spark.sql(sql)
        except Exception as e:
            raise EngineError("INVALID_ARGUMENT", str(e).splitlines()[0]) from e
