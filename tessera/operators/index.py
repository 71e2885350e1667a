"""Inverted-file index: vectors in cells about centroids, probed and ranked exactly.

The graph parameters of the store's own index are taken for compatibility and have no effect.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.errors import invalid
from tessera.functions.vectors import parse_metric
from tessera.operators.knn import DIGITS, Nearest, distances
from tessera.schema import extended


MOST_CELLS = 4096


@dataclass(frozen=True)
class IndexConfig:
    """m, ef_construction, ef_search, max_layers: accepted, unused. sample: rows that centroids are fitted on.
    n_cells: 0 for about the square root of the number of vectors, at most MOST_CELLS."""

    dimension: int = 128
    metric: str = "cosine"
    n_cells: int = 32
    sample: int = 20_000
    iterations: int = 12
    seed: int = 42
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    max_layers: int = 16

    def __post_init__(self):
        if self.dimension <= 0 or self.m <= 0 or self.n_cells < 0:
            raise invalid("dimension, m and n_cells must be positive (n_cells may be 0)")
        parse_metric(self.metric)


def _centroids(points: np.ndarray, config: IndexConfig) -> np.ndarray:
    rng = np.random.default_rng(config.seed)
    k = min(config.n_cells, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(config.iterations):
        cell = np.argmin(distances(points, centres, "euclidean"), axis=1)
        for c in range(k):
            own = points[cell == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension, a row each."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class CellIndex:
    """build() fits on a bounded sample and assigns every vector; search() probes the nearest cells."""

    def __init__(self, config: IndexConfig, centres: np.ndarray, cells: DataFrame):
        self.config, self.centres, self.cells = config, centres, cells

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig, key: str = "key", vector: str = "vector") -> CellIndex:
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(F.size("vector") == config.dimension)
        total = rows.count()
        spot = F.pmod(F.xxhash64("key", F.lit(config.seed)), F.lit(1 << 30))
        sampled = rows.where(spot < int((1 << 30) * min(1.0, config.sample / max(1, total)))).orderBy("key").select("vector").toArrow()
        if not config.n_cells:
            config = replace(config, n_cells=max(1, min(MOST_CELLS, round(total**0.5))))
        points = np.array(sampled.column("vector").to_pylist(), dtype=np.float64).reshape(-1, config.dimension)
        centres = _centroids(points, config) if len(points) else np.zeros((0, config.dimension))
        held = rows.sparkSession.sparkContext.broadcast(centres)  # n_cells rows

        def work(batches):
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = np.argmin(distances(x, held.value, "euclidean"), axis=1) if len(held.value) else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["key", "vector", "cell"])

        return cls(config, centres, rows.mapInArrow(work, extended(rows.schema, cell="int")))

    def write(self, path: str) -> CellIndex:
        """Writes the index and gives it as read back: cells are a table of a folder each, so that a probe reads only
        what it needs and no vector's cell is sought again; centres and config are a table of one row."""
        spark = self.cells.sparkSession
        self.cells.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps(asdict(self.config)), self.centres.tolist())], "config string, centres array<array<double>>").coalesce(1).write.parquet(f"{path}/about")
        return CellIndex.read(spark, path, self.cells.schema)

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: StructType | None = None) -> CellIndex:
        """An index that write() made, in this session or another."""
        about = spark.read.parquet(f"{path}/about").first()
        config = IndexConfig(**json.loads(about["config"]))
        centres = np.array(about["centres"], dtype=np.float64).reshape(-1, config.dimension)
        reader = spark.read if schema is None else spark.read.schema(schema)
        return cls(config, centres, reader.parquet(f"{path}/cells").select("key", "vector", F.col("cell").cast("int").alias("cell")))

    def search(self, query, k: int = 10, n_probe: int = 20, deleted: DataFrame | None = None) -> DataFrame:
        """key, distance of the k nearest within the probed cells; deleted keys are dropped first."""
        from tessera.operators.knn import knn

        if len(query) != self.config.dimension or not len(self.centres):
            return knn(self.cells, query, 0, self.config.metric)
        near = np.argsort(distances(np.array([query], float), self.centres, "euclidean")[0], kind="stable")[:n_probe]
        rows = self.cells.where(F.col("cell").isin(*map(int, near)))
        if deleted is not None:
            rows = rows.join(deleted.select("key"), "key", "left_anti")
        return knn(rows, query, k, self.config.metric)

    def stats(self) -> DataFrame:
        """num_vectors, n_cells in use, largest cell."""
        sizes = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_vectors"), F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cell"))

    def search_batch(self, queries: DataFrame, k: int = 10, n_probe: int = 12, key: str = "key", vector: str = "vector") -> DataFrame:
        """query_id, key, distance, rank for a stated set of queries: each joins its probed cells.

        A cell's vectors meet its queries in one group of a cell and salt; every group passes on k a query, and takes
        a bounded number of distances at a time.
        """
        held = self.cells.sparkSession.sparkContext.broadcast(self.centres)
        metric = parse_metric(self.config.metric)

        def probe(batches):
            for batch in batches:
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argsort(distances(q, held.value, "euclidean"), axis=1, kind="stable")[:, :n_probe]
                rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(near.reshape(-1), pa.int32())], names=["query_id", "query", "cell"])

        salts = 8
        asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("query")).where(F.size("query") == self.config.dimension)
        asked = asked.mapInArrow(probe, "query_id long, query array<float>, cell int").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        cells = self.cells.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))

        def rank(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if left.num_rows and right.num_rows:
                nearest = Nearest(_matrix(left.column("query")), k, metric, DIGITS)
                nearest.add(_matrix(right.column("vector")), right.column("key").to_numpy())
                found.extend(nearest.found())
            who, keys, distance = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table({"query_id": left.column("query_id").take(pa.array(who)), "key": pa.array(keys, pa.int64()), "distance": pa.array(distance, pa.float64())})

        found = asked.groupBy("cell", "salt").cogroup(cells.groupBy("cell", "salt")).applyInArrow(rank, "query_id long, key long, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", "key")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
