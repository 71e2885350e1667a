from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.api import Vector
from tessera.errors import CODES, EngineError
from tessera.functions import codec, vectors as V
from tessera.operators import index, knn

POINTS = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [3.0, 4.0]]


def pairs(spark):
    return spark.createDataFrame([(i, j, POINTS[i], POINTS[j]) for i in range(5) for j in range(5)], "i int, j int, a array<float>, b array<float>")


def test_metrics_against_numpy(spark):
    rows = pairs(spark).select("i", "j", *[V.distance(F.col("a"), F.col("b"), m).alias(m) for m in V.METRICS]).collect()
    for r in rows:
        a, b = np.array(POINTS[r.i]), np.array(POINTS[r.j])
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        assert r.cosine == pytest.approx(1 - (a @ b / norm if norm else 0.0))
        assert r.euclidean == pytest.approx(np.linalg.norm(a - b))
        assert r.dot_product == pytest.approx(-(a @ b))
        assert r.manhattan == pytest.approx(np.abs(a - b).sum())
        assert -1e-12 <= r.cosine <= 2 + 1e-12
    for m in V.METRICS:
        d = knn.distances(np.array(POINTS), np.array(POINTS), m)
        by = {(r.i, r.j): r[m] for r in rows}
        assert all(d[i, j] == pytest.approx(by[i, j], abs=1e-7) for i, j in by)
        assert all(by[i, j] == pytest.approx(by[j, i]) for i, j in by)


def test_zero_vector_rules(spark):
    zero, one = V.literal([0, 0]), V.literal([1, 0])
    r = spark.range(1).select(V.cosine_similarity(zero, one).alias("s"), V.cosine_distance(zero, zero).alias("d"), V.normalize(zero).alias("n"), V.magnitude(V.normalize(V.literal([3, 4]))).alias("m")).first()
    assert (r.s, r.d, r.n, r.m) == (0.0, 1.0, [0.0, 0.0], pytest.approx(1.0))


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        spark.range(1).select(V.distance(V.literal([1, 2]), V.literal([1, 2, 3]))).collect()


def test_metric_names():
    assert V.parse_metric("L2") == "euclidean" and V.parse_metric("Inner") == "dot_product" and V.parse_metric("l1") == "manhattan"
    assert V.metric_name("nonsense") == "unknown"
    with pytest.raises(EngineError) as e:
        V.parse_metric("nonsense")
    assert str(e.value).startswith("INVALID_ARGUMENT: ") and e.value.code in CODES


def test_csv(spark):
    df = spark.createDataFrame([("0.1,abc",), ("",), ("1,2,",), ("1, 2.5",)], "s string").select(V.parse_csv(F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == [None, None, None, [1.0, 2.5]]


@settings(max_examples=50, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), max_size=40))
def test_codec_round_trip(values):
    assert codec.from_bytes(codec.to_bytes(values)).tolist() == np.array(values, np.float32).tolist()


def test_codec_refuses_bad_lengths():
    for data in (b"", b"abc", codec.to_bytes([1.0, 2.0])[:-1], codec.to_bytes([1.0]) + b"x"):
        with pytest.raises(EngineError):
            codec.from_bytes(data)


def test_codec_columns(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [])], "key string, vector array<float>")
    back = codec.decode(codec.encode(df, "vector"), "value", "again").select("key", "again", codec.looks_like_vector(F.col("value")).alias("looks"))
    assert {r.key: (r.again, r.looks) for r in back.collect()} == {"a": ([1.0, 2.0], True), "b": (None, False), "c": ([], False)}


def test_knn_ties_k_and_dimensions(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 2.0, 3.0])], "key string, vector array<float>")
    assert [r.key for r in knn.knn(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r.key for r in knn.knn(v, [1.0, 0.0], 99).collect()] == ["a", "b", "c"]
    assert knn.knn(v, [1.0, 0.0], 0).count() == 0 and knn.knn(v, [1.0], 5).count() == 0
    assert knn.knn(v.where("false"), [1.0, 0.0], 5).count() == 0
    assert knn.knn(v, [1.0, 0.0], 1, include_vectors=True).first().vector == [1.0, 0.0]


def test_knn_join_equals_single_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    v = spark.createDataFrame(rows, "key long, vector array<float>").repartition(5)
    queries = v.where("key < 6")
    for metric in V.METRICS:
        got = {}
        for r in knn.knn_join(v, queries, 7, metric).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.key))
        for q in range(6):
            assert [k for _, k in sorted(got[q])] == [r.key for r in knn.knn(v, rows[q][1], 7, metric).collect()]
    assert knn.knn_join(v, queries.where("false")).count() == 0 and knn.knn_join(v, queries, 0).count() == 0


def test_k_exceeds_a_table_of_more_than_a_million(spark, tmp_path):
    from tessera.plans import registry

    n = 1_000_003
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7 + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["knn_k_exceeds_n"](spark, str(tmp_path)).count() == n


def test_index_recall_of_single_queries_at_defaults(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    queries = v.where("key % 50 = 0")
    built = index.CellIndex.build(v, index.IndexConfig(dimension=64))
    built.cells = built.cells.cache()
    exact = {(r.query_id, r.key) for r in knn.knn_join(v, queries, 10).collect()}
    found = {(q.key, r.key) for q in queries.collect() for r in built.search(q.vector).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_index_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    queries = v.where("key % 50 = 0")
    built = index.CellIndex.build(v, index.IndexConfig(dimension=64, n_cells=16))
    exact = {(r.query_id, r.key) for r in knn.knn_join(v, queries, 10).collect()}
    found = {(r.query_id, r.key) for r in built.search_batch(queries, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert built.stats().first().num_vectors == v.count()
    one = queries.first()
    assert built.search(one.vector, 3, 16).first().key == one.key
    gone = spark.createDataFrame([(one.key,)], "key long")
    assert built.search(one.vector, 3, 16, gone).count() == 3 and one.key not in {r.key for r in built.search(one.vector, 3, 16, gone).collect()}
    with pytest.raises(EngineError):
        index.IndexConfig(dimension=0)


def test_index_is_stored_and_pruned(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    built = index.CellIndex.build(v, index.IndexConfig(dimension=64, n_cells=0))
    assert built.config.n_cells == round(v.count() ** 0.5)
    kept = built.write(str(tmp_path / "index"))
    again = index.CellIndex.read(spark, str(tmp_path / "index"))
    query = v.where("key = 3").first().vector
    want = built.search(query, 5).collect()
    assert kept.search(query, 5).collect() == want == again.search(query, 5).collect()
    assert again.config == built.config and again.stats().first().num_vectors == v.count()
    plan = again.search(query, 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "MapInArrow" not in plan


def test_null_keys_neither_ask_nor_are_found(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "key long, vector array<float>")
    assert [(r.query_id, r.key) for r in knn.knn_join(v, v, 1).orderBy("query_id").collect()] == [(1, 1), (2, 2)]
    assert {(r.node, r.neighbour) for r in knn.neighbour_graph(v, v, 1).collect()} == {(1, 2), (2, 1)}


def test_batch_search_holds_few_distances_at_once(spark):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    class Vectors:
        """Keeps the function that Spark would run, and runs it here."""

        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        where = select = lambda self, *_: self

        def mapInArrow(self, work, schema):
            return work

    def peak(n_queries):
        rng = np.random.default_rng(5)
        rows = rng.normal(size=(4096, 8))
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows.astype(np.float32)))], names=["key", "vector"])
        asked = rows[:n_queries].astype(np.float32).astype(np.float64)
        work = knn._block(Vectors(), np.arange(n_queries), asked, 3, "cosine", "key", "vector", 6)
        tracemalloc.start()
        found = pa.Table.from_batches(list(work(iter([batch]))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        first = found.group_by("query_id").aggregate([("distance", "min"), ("key", "count")])
        assert first.num_rows == n_queries and set(first.column("distance_min").to_pylist()) == {0.0} and set(first.column("key_count").to_pylist()) == {3}
        return most

    assert peak(4096) < 64e6  # all distances to 2,048 rows are 67 MB


def test_index_batch_search_holds_few_distances_at_once(spark):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    class Cells:
        """Keeps the function that Spark would run on a cell's queries and vectors."""

        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def __getattr__(self, name):
            return lambda *a: self

        def applyInArrow(self, rank, schema):
            self.rank = rank
            return self

    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 8)).astype(np.float32)
    keys, vectors = pa.array(rng.permutation(3000)), pa.array(list(points))
    rank = index.CellIndex(index.IndexConfig(dimension=8, metric="l2"), points[:4].astype(float), Cells()).search_batch(Cells(), 3).rank
    asked, held = pa.table({"query_id": keys, "query": vectors}), pa.table({"key": keys, "vector": vectors})
    tracemalloc.start()
    found = rank(asked, held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = {q: k for q, k, d in zip(*(found.column(c).to_pylist() for c in ("query_id", "key", "distance")), strict=True) if d == 0}
    assert found.num_rows == 9000 and first == {k: k for k in range(3000)}
    assert rank(asked.slice(0, 0), held).num_rows == 0 == rank(asked, held.slice(0, 0)).num_rows
    assert most < 64e6  # all distances are 72 MB


def test_batch_search_over_many_blocks_of_ties(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(0, 2, 2)]) for i in rng.permutation(5000)]
    v = spark.createDataFrame(rows, "key long, vector array<float>").coalesce(1)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 400)
    by_key = dict(rows)
    points = np.array([by_key[i] for i in range(5000)])
    got = {}
    for r in knn.knn_join(v, v.where("key < 600"), 9, "l1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.key))
    for q in range(600):
        d = np.abs(points - points[q]).sum(1)
        order = np.lexsort((np.arange(5000), d))[:9]
        assert sorted(got[q]) == [(i + 1, d[x], x) for i, x in enumerate(order)]


def test_a_distance_that_is_no_number_comes_last(spark):
    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.0, 1.0])], "key long, vector array<float>").coalesce(1)
    for k, want in ((2, [1, 3]), (5, [1, 3, 2])):
        assert [r.key for r in knn.knn_join(v, v.where("key = 1"), k).orderBy("rank").collect()] == want == [r.key for r in knn.knn(v, [1.0, 0.0], k).collect()]
        assert [r.key for r in knn.knn_join(v, v.where("key = 1"), k, "l2").orderBy("rank").collect()] == want
    assert [r.key for r in knn.knn_join(v, v.where("key = 2"), 2).orderBy("rank").collect()] == [1, 2]


def test_client_vector():
    a, b = Vector([3, 4]), Vector([0, 0])
    assert a.magnitude() == 5 and a.normalize().to_list() == pytest.approx([0.6, 0.8]) and b.normalize() == b
    assert a.cosine_similarity(b) == 0 and a.euclidean_distance(b) == 5 and len(a) == 2 and a[1] == 4
    a[1] = 7
    assert a.to_list() == [3, 7]
    with pytest.raises(EngineError):
        a.dot_product(Vector([1]))
