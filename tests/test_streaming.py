from __future__ import annotations

import datetime as dt

from tessera.operators import limiter, oplog
from tessera.streaming import stateful

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def stream(spark, path, batches, schema):
    """A file stream of the batches, one file a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_op_log_state(spark, tmp_path):
    ops = [[(1, "put", "a", "1"), (2, "put", "b", "2")], [(3, "delete", "a", None), (5, "put", "c", "5")], [(4, "put", "c", "late"), (6, "put", "a", "6")]]
    schema = "seq long, op string, key string, value string"
    rows = run(stateful.op_log_state(stream(spark, str(tmp_path / "in"), ops, schema)), "ops", "update", tmp_path)
    last = {}
    for r in sorted(rows, key=lambda r: r.seq):
        last[r.key] = (r.op, r.value)
    flat = spark.createDataFrame([x for b in ops for x in b], schema)
    assert {k: v for k, (op, v) in last.items() if op == "put"} == {r.key: r.value for r in oplog.current_state(flat).collect()} == {"a": "6", "b": "2", "c": "5"}


def test_limiter_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(seconds=i * 0.3), i) for i in range(60)]
    schema = "client string, ts timestamp, request_id long"
    got = run(stateful.limiter_decisions(stream(spark, str(tmp_path / "in"), [rows[:20], rows[20:45], rows[45:]], schema), 1.0, 3.0), "limits", "append", tmp_path)
    want = {r.request_id: r.allowed for r in limiter.decisions(spark.createDataFrame(rows, schema), 1.0, 3.0).collect()}
    assert {r.request_id: r.allowed for r in got} == want


def test_sessions_and_histograms(spark, tmp_path):
    times = [0, 60, 60 + 1800, 60 + 1800 + 1799, 20_000]
    schema = "user_id long, ts timestamp"
    batches = [[(1, T0 + dt.timedelta(seconds=t))] for t in times]
    got = run(stateful.sessions(stream(spark, str(tmp_path / "in"), batches, schema)), "sess", "append", tmp_path)
    assert sorted(r.n_events for r in got) == [2, 2]
    schema = "name string, ts timestamp, value double"
    batches = [[("get", T0 + dt.timedelta(seconds=10 * i), v)] for i, v in enumerate((0.001, 0.0005, 0.3))] + [[("get", T0 + dt.timedelta(hours=3), 1.0)]]
    got = run(stateful.windowed_histogram(stream(spark, str(tmp_path / "h"), batches, schema)), "hist", "append", tmp_path)
    assert sorted((r.le, r["count"]) for r in got) == [(0.001, 2), (0.5, 1)]


def test_batches_are_applied_once(spark, tmp_path):
    schema = "seq long, op string, key string, value string"
    ops = [[(1, "put", "a", "1")], [(2, "put", "a", "2")]]
    q = stateful.apply_batches(stream(spark, str(tmp_path / "in"), ops, schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.count() == 2 and oplog.current_state(log).first().value == "2"
