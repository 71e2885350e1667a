"""Nearest neighbours: exact by expression for one query, by Arrow blocks for many.

Ties go to the smaller key. A query whose dimension differs from a vector's finds nothing there; k <= 0
finds nothing; k beyond the number of vectors finds all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

QUERY_BLOCK = 4096
#: Distances that a task holds at once, and elements of the vectors they are taken to: 2^19 doubles are 4 MB.
HELD = 1 << 19
DIGITS = 6


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", key: str = "key", vector: str = "vector", where: Column | None = None, include_vectors: bool = False, digits: int | None = DIGITS) -> DataFrame:
    """The k nearest to one query: key, distance and, if asked for, the vector; `where` filters before.

    One scan, a distance expression against a literal, and a top-k without a full sort.
    """
    metric = V.parse_metric(metric)
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.size(vector) == len(query))
    d = V.distance(F.col(vector), V.literal(query), metric, checked=False)
    columns = [F.col(key), (F.round(d, digits) if digits is not None else d).alias("distance"), *([F.col(vector)] if include_vectors else [])]
    return rows.select(*columns).orderBy("distance", key).limit(max(k, 0))


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each query to each row, in doubles."""
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    if metric == "manhattan":
        out = np.empty((len(q), len(x)))
        for i, one in enumerate(q):
            out[i] = np.abs(x - one).sum(axis=1)
        return out
    dot = q @ x.T
    if metric == "dot_product":
        return -dot
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)
    square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dot
    return np.sqrt(np.maximum(square, 0))


class Nearest:
    """The k nearest of all added vectors to each row of a matrix; HELD distances are taken at a time."""

    def __init__(self, matrix: np.ndarray, k: int, metric: str, digits: int):
        self.matrix, self.k, self.metric, self.digits = matrix, k, metric, digits
        self.n_rows = max(1, min(2048, HELD // max(1, matrix.shape[1])))
        n_queries = max(1, HELD // self.n_rows)
        self.parts = [slice(i, min(i + n_queries, len(matrix))) for i in range(0, len(matrix), n_queries)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.best = [(none, np.full(p.stop - p.start, np.inf)) for p in self.parts]

    def add(self, rows: np.ndarray, keys: np.ndarray) -> None:
        for at in range(0, len(rows) if self.k > 0 else 0, self.n_rows):
            some = rows[at : at + self.n_rows]
            for i, p in enumerate(self.parts):
                d = np.round(distances(self.matrix[p], some, self.metric), self.digits) + 0.0  # no negative zero
                self.best[i] = self._nearer(*self.best[i], d, keys[at : at + self.n_rows])

    def _nearer(self, best: tuple[np.ndarray, ...], worst: np.ndarray, d: np.ndarray, keys: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The k nearest among the best so far and a block of distances: (matrix row, key, distance) by row, distance and
        key, and each row's k-th distance, infinite where it has fewer. Ties at the edge are compared by key; NaN comes last."""
        n, k = len(d), self.k
        near = ~(d > worst[:, None])
        if d.shape[1] > k and np.count_nonzero(near) > 4 * k * n:
            near = ~(d > np.fmin(worst, np.partition(d, k - 1, axis=1)[:, k - 1])[:, None])
        who, at = np.nonzero(near)
        who, key, distance = (np.concatenate(x) for x in zip(best, (who, keys[at], d[who, at]), strict=True))
        order = np.lexsort((key, distance, who))
        who = who[order]
        kept = np.arange(len(who)) - np.searchsorted(who, np.arange(n))[who] < k
        who, key, distance = who[kept], key[order[kept]], distance[order[kept]]
        counts = np.bincount(who, minlength=n)
        edge = np.full(n, np.inf)
        edge[counts == k] = distance[np.cumsum(counts)[counts == k] - 1]
        return (who, key, distance), edge

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matrix rows, keys and distances, of some rows at a time."""
        for p, ((who, key, distance), _) in zip(self.parts, self.best, strict=True):
            if len(who):
                yield who + p.start, key, distance


def _block(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, key: str, vector: str, digits: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))  # QUERY_BLOCK rows at most

    def work(batches):
        ids, matrix = held.value
        nearest = Nearest(matrix, k, metric, digits)
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(1))
            batch = batch.filter(pa.compute.equal(size, matrix.shape[1]).fill_null(False))
            if batch.num_rows:
                nearest.add(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(0).to_numpy())
        for who, keys, distance in nearest.found():
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(keys), pa.array(distance)], names=["query_id", "key", "distance"])

    return vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(work, "query_id long, key long, distance double")


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "key", vector: str = "vector", query_key: str = "key", query_vector: str = "vector", digits: int = DIGITS) -> DataFrame:
    """For each query its k nearest: query_id, key, distance, rank from 1. Keys are integers; a row whose key is null
    neither asks nor is found.

    The queries are a stated set; they are broadcast in blocks of QUERY_BLOCK and held against all vectors,
    of which each task passes on k a query. A task takes HELD distances at a time, however many queries it has.
    """
    metric = V.parse_metric(metric)
    empty = "query_id long, key long, distance double, rank int"
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], empty)
    queries = queries.where(F.col(query_key).isNotNull())
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK) * 2 if total > QUERY_BLOCK else 1)
    found = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b) if blocks > 1 else queries
        table = own.select(F.col(query_key).cast("long").alias("id"), F.col(query_vector).alias("v")).where("v is not null").toArrow()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(table.column("v").to_pylist()):
            by_size.setdefault(len(v), []).append(i)
        for rows in by_size.values():
            part = table.take(rows)
            matrix = np.array(part.column("v").to_pylist(), dtype=np.float64).reshape(len(rows), -1)
            one = _block(vectors, part.column("id").to_numpy(), matrix, k, metric, key, vector, digits)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], empty)
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_vectors(hits: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """Hits joined to their vectors; a hit without one stays."""
    return hits.join(vectors, key, "left")


def with_text(hits: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hits joined to the texts they stand for."""
    return hits.join(texts, key)


def neighbour_graph(vectors: DataFrame, nodes: DataFrame, m: int = 16, metric: str = "cosine", key: str = "key", vector: str = "vector") -> DataFrame:
    """Edges (node, neighbour, distance, rank) to the m nearest others of each stated node."""
    hits = knn_join(vectors, nodes, m + 1, metric, key, vector, key, vector)
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    others = hits.where("query_id != key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)
    return others.select(F.col("query_id").alias("node"), F.col("key").alias("neighbour"), "distance", "rank")


def vector_stats(vectors: DataFrame, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """num_vectors, dimension (of the first by size), distinct dimensions and the metric."""
    size = F.size(vector)
    return vectors.where(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("num_vectors"), F.max(size).alias("dimension"), F.countDistinct(size).alias("n_dimensions"), F.lit(V.parse_metric(metric)).alias("metric"))
