from __future__ import annotations

import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.api import Store
from tessera.errors import EngineError
from tessera.functions import text as T
from tessera.operators import kv, oplog
from tessera.sources import text as sources


def table(spark, items):
    return spark.createDataFrame(items, "key string, value string")


def hundred(spark):
    return table(spark, [(f"key_{i:03d}", f"value_{i}") for i in range(100)])


def test_scan(spark):
    t = hundred(spark)
    keys = lambda **o: [r.key for r in kv.scan(t, "key_010", "key_020", **o).collect()]
    assert keys() == [f"key_{i:03d}" for i in range(10, 20)] and keys(reverse=True) == keys()[::-1]
    assert keys(limit=5) == keys()[:5] and keys(reverse=True, limit=5) == keys()[::-1][:5]
    assert {r.value for r in kv.scan(t, "key_010", "key_020", keys_only=True).collect()} == {""}
    assert kv.scan(t, "key_020", "key_010").count() == 0
    with pytest.raises(EngineError):
        kv.scan(t, "a", "b", limit=-1)


def test_scan_pushes_its_range_and_prunes_values(spark, tmp_path):
    hundred(spark).write.parquet(str(tmp_path / "kv"))
    plan = kv.scan(spark.read.parquet(str(tmp_path / "kv")), "key_010", "key_020", keys_only=True)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,key_010)" in plan and "LessThan(key,key_020)" in plan and "ReadSchema: struct<key:string>" in plan


def test_keys_compare_by_bytes(spark):
    t = table(spark, [(k, "") for k in ("键", "é", "z", "a", "Z")])
    assert [r.key for r in kv.scan(t, "A", "\U0010ffff").collect()] == ["Z", "a", "z", "é", "键"]


def test_batch_get_keeps_order_repeats_and_holes(spark):
    got = [(r.pos, r.key, r.value) for r in kv.batch_get(hundred(spark), ["key_000", "missing_key", "key_010", "key_000"]).collect()]
    assert got == [(0, "key_000", "value_0"), (1, "missing_key", None), (2, "key_010", "value_10"), (3, "key_000", "value_0")]


def test_mixed_batch(spark):
    base = table(spark, [(f"key{i}", f"original{i}") for i in range(50)])
    ops = [("put", f"key{i}", f"updated{i}") for i in range(25)] + [("delete", f"key{i}", None) for i in range(25, 50)] + [("put", f"key{i}", f"new{i}") for i in range(50, 100)]
    state = {r.key: r.value for r in oplog.apply_batch(base, oplog.operations(spark, ops)).collect()}
    assert len(state) == 75 and state["key3"] == "updated3" and "key30" not in state and state["key99"] == "new99"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["put", "delete"]), st.sampled_from("abcd"), st.text("xyz", max_size=3)), max_size=15))
def test_state_is_a_replay(spark, ops):
    want = {}
    for op, key, value in ops:
        want.pop(key, None)
        if op == "put":
            want[key] = value
    log = oplog.operations(spark, [(o, k, v if o == "put" else None) for o, k, v in ops]) if ops else spark.createDataFrame([], "seq long, op string, key string, value string")
    assert {r.key: r.value for r in oplog.current_state(log).collect()} == want


def test_store(spark, tmp_path):
    with Store(spark, str(tmp_path / "db"), dimension=3) as s:
        assert s.get("hello") is None and s.entries().count() == 0
        s.put("hello", "world")
        s.put("键", "值")
        s.put("hello", "again")
        s.delete("missing")
        s.begin_batch()
        s.begin_batch()
        s.put("k", "v")
        assert s.in_batch() and s.get("k") is None
        s.end_batch()
        s.end_batch()
        assert s.batch_get(["k", "hello", "none"]) == {"k": "v", "hello": "again", "none": None}
        s.delete("k")
        s.batch_put_vectors({"a": [1, 0, 0], "b": [0, 1, 0], "c": [1, 1, 0]})
        with pytest.raises(EngineError):
            s.put_vector("bad", [1.0])
        assert [r.key for r in s.search_similar([1, 0, 0], 2).collect()] == ["a", "c"]
        s.put_vector("b", [1, 0, 0])
        s.delete("a")
        assert [r.key for r in s.search_similar([1, 0, 0], 2).collect()] == ["b", "c"] and s.get_vector("a") is None
        assert s.batch_get_vectors(["c", "x"])["x"] is None and s.vector_stats().first().num_vectors == 2
        assert s.execute("SELECT count(*) AS n FROM entries").first().n == 2
        assert s.health() == "HEALTHY" and "tessera_total_entries 2" in s.prometheus_text()
        with pytest.raises(EngineError):
            s.execute("SELECT nothing FROM nowhere")
    again = Store(spark, str(tmp_path / "db"), dimension=3)
    assert {r.key: r.value for r in again.entries().collect()} == {"hello": "again", "键": "值"}
    again.clear()
    assert again.entries().count() == 0
    again.put("hello", "back")
    assert again.get("hello") == "back"


def test_put_vectors_conflict(spark):
    old = spark.createDataFrame([("a", [1.0])], "key string, vector array<float>")
    new = spark.createDataFrame([("a", [2.0])], "key string, vector array<float>")
    assert oplog.put_vectors(old, new, 1).first().vector == [2.0]
    with pytest.raises(EngineError, match="ALREADY_EXISTS"):
        oplog.put_vectors(old, new, 1, "error")
    with pytest.raises(EngineError):
        oplog.put_vectors(old, new, 2)


def test_text_sources(spark, tmp_path):
    lines = spark.createDataFrame([("a=1",), (" b = x=y ",), ("",), ("=3",), ("c=",), ("none",)], "value string")
    assert {(r.key, r.value) for r in sources.parse_lines(lines).collect()} == {("a", "1"), ("b", "x=y")}
    tokens = spark.createDataFrame([("a:1",), ("b:2:3",), ("none",)], "token string")
    assert {(r.key, r.value) for r in sources.parse_tokens(tokens).collect()} == {("a", "1"), ("b", "2:3")}
    s = sources.Settings.parse("# no\nserver.port = 9090\nsecurity.require_authentication=false\ndatabase.data_dir=/x\nunknown=1\nbad line\n")
    assert (s.server_port, s.security_require_authentication, s.database_data_dir) == (9090, False, "/x")
    assert sources.Settings.parse(s.text()) == s and sources.Settings.production().server_port == 443
    sources.export_json(table(spark, [('q"', "a\nb")]), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first() == ('q"', "a\nb")
    assert sources.files(spark, str(tmp_path)).count() >= 1


def test_text_functions(spark):
    df = spark.createDataFrame([("abcdef", 500, b"123456789"), ("abc", 2048, b"")], "s string, n long, b binary")
    rows = df.select(T.preview(F.col("s"), 3).alias("p"), T.human_bytes(F.col("n")).alias("h"), T.checksum(F.col("b")).alias("c")).collect()
    assert [(r.p, r.h) for r in rows] == [("abc...", "500 B"), ("abc", "2.0 KB")] and rows[0].c == zlib.crc32(b"123456789") == 3421780262
    assert T.split_arguments("put 'a b'  \"c d\" e") == ["put", "a b", "c d", "e"]


def test_wal(spark):
    wal = spark.createDataFrame([(i,) for i in range(1, 9)], "lsn long")
    assert [r.lsn for r in oplog.wal_forward(wal, 6).collect()] == [6, 7, 8] and [r.lsn for r in oplog.wal_backward(wal, 2).collect()] == [2, 1]
    lsns = [r.lsn for r in oplog.numbered(wal.select(F.col("lsn").alias("x")), ["x"]).orderBy("x").collect()]
    assert lsns == sorted(set(lsns)) and lsns[0] == 1


def test_commands(spark, tmp_path):
    from tessera.cli import run

    s = Store(spark, str(tmp_path / "cli"), dimension=2)
    assert run(s, ["put", "a", "x", "y"]) == ["OK"] and run(s, ["get", "a"]) == ["x y"]
    run(s, ["bput", "b:1", "c:2:3", "nothing"])
    assert run(s, ["bget", "b", "z"]) == ["b = 1", "z = (not found)"]
    assert run(s, ["scan", "a", "z", "2"]) == ["a = x y", "b = 1"]
    run(s, ["vput", "v", "1,0"])
    assert run(s, ["vget", "v"]) == ["1,0"] and run(s, ["vsearch", "1,0", "1"]) == ["v 0"]
    run(s, ["delete", "a"])
    assert run(s, ["get", "a"]) == ["(not found)"] and "total_entries: 2" in run(s, ["stats"])
    for bad in (["vput", "v", "x"], ["get"], ["fly"]):
        with pytest.raises(EngineError):
            run(s, bad)
