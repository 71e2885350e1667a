from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators import access, audit, cache, limiter, metrics
from tessera.sources import fvecs, generate

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def test_histogram_edges(spark):
    values = [0.001, 0.005, 0.0051, 10.0, 10.5, None]
    obs = spark.createDataFrame([("get", v) for v in values], "name string, value double")
    h = {r.le: r["count"] for r in metrics.histogram(obs).collect()}
    assert len(h) == 10 and (h[0.001], h[0.005], h[0.01], h[10.0], h[float("inf")]) == (1, 1, 1, 1, 1)
    c = {r.le: r.cumulative for r in metrics.cumulative(metrics.histogram(obs)).collect()}
    assert c[float("inf")] == 5 and c[1.0] == 3
    lines = [r.line for r in metrics.prometheus_lines(spark.createDataFrame([], "name string, type string, value double"), obs).orderBy("part", "le").collect()]
    assert 'get_bucket{le="+Inf"} 5' in lines and "get_count 5" in lines and any(x.startswith("get_sum 20.51") for x in lines)


def test_counters_gauges_health(spark):
    m = spark.createDataFrame([("c", 10.0, at(0)), ("c", 5.0, at(1))], "name string, value double, ts timestamp")
    assert metrics.counters(m).first().value == 15 and metrics.gauges(m).first().value == 5
    for rows, want in (([("database", True), ("x", True)], "HEALTHY"), ([("database", True), ("x", False)], "DEGRADED"), ([("database", False), ("x", True)], "UNHEALTHY")):
        assert metrics.health(spark.createDataFrame(rows, "name string, ok boolean")).first().status == want
    empty = spark.createDataFrame([], "kind string")
    assert metrics.pool_stats(empty).first().hit_rate == 0.0


def test_limiter_burst_and_refill(spark):
    requests = spark.createDataFrame([("a", at(0.001 * i), i) for i in range(26)] + [("a", at(0.3), 99)], "client string, ts timestamp, request_id long")
    got = {r.request_id: r.allowed for r in limiter.decisions(requests, 10, 20).collect()}
    assert all(got[i] for i in range(20)) and not all(got[i] for i in range(20, 26)) and got[99]
    s = limiter.stats(limiter.decisions(requests, 10, 20)).first()
    assert s.total == 27 and s.allowed + s.denied == 27
    assert limiter.stats(limiter.decisions(requests.where("false"), 10, 20)).first().allow_rate == 100.0


def test_limiter_carries_buckets_over_batches(spark):
    rows = [(f"c{i % 3}" if i % 7 else None, at(i * 0.4), i) for i in range(300)]
    requests = spark.createDataFrame(rows, "client string, ts timestamp, request_id long")
    want = {}
    buckets: dict = {}
    for client, ts, i in rows:
        buckets[client], want[i] = limiter.step(buckets.get(client), round((ts - T0).total_seconds() * 1e6), 0.5, 2.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.request_id: r.allowed for r in limiter.decisions(requests, 0.5, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_limiter_endpoints(spark):
    requests = spark.createDataFrame([("put", "a", at(i * 1e-3), i) for i in range(30)] + [("delete", "a", at(i * 1e-3), 100 + i) for i in range(30)] + [("x", "a", at(0), 200)], "endpoint string, client string, ts timestamp, request_id long")
    s = {r.limiter: r for r in limiter.stats(limiter.by_endpoint(requests, {"put": (100, 200), "delete": (10, 20)}), ["limiter"]).collect()}
    assert set(s) == {"put", "delete", "_default"} and s["put"].denied == 0 and s["delete"].denied == 9


def test_audit(spark):
    events = spark.createDataFrame(
        [(at(1), "LOGIN", "alice", "1.1.1.1", None, True), (at(2), "LOGIN_FAILED", "bob", "1.1.1.2", None, False), (at(3), "PUT", "alice", None, "k", True), (at(4), "UNAUTHORIZED", "eve", None, "delete", False), (at(5), "ODD", "eve", None, "?", True), (at(6), "BATCH", "bob", None, "7", True)],
        "ts timestamp, kind string, username string, ip string, subject string, success boolean",
    )
    a = audit.entries(events)
    assert audit.counts(a).first() == (6, 1, 1)
    assert [r.details for r in audit.by_user(a, "alice").collect()] == ["PUT key: k", "User logged in"]
    assert [r.details for r in audit.recent(a, 2).collect()] == ["?", "Batch operation: 7 entries"]
    assert audit.in_range(a, at(2), at(4)).count() == 3 and audit.by_type(a, "UNKNOWN").count() == 1
    assert a.orderBy("ts").select(audit.text_line()).first()[0] == "[2024-01-01 00:00:01] SUCCESS User:alice IP:1.1.1.1 Details:User logged in"


def test_access(spark):
    users = spark.createDataFrame([("root", ["admin"], True), ("basic", ["user"], True), ("guest", ["guest"], True), ("none", None, True)], "username string, roles array<string>, is_active boolean")
    p = {r.username: tuple(r)[1:] for r in access.permissions(users).collect()}
    assert p == {"root": (True, True, True, True), "basic": (True, True, False, False), "guest": (False,) * 4, "none": (False,) * 4}
    assert access.create_user(users, "new").count() == 5 and access.user_exists(users, "root")
    with pytest.raises(EngineError):
        access.create_user(users, "root")
    assert not access.deactivate(users, "root").where("username = 'root'").first().is_active


def test_sessions_expire_after_whole_minutes(spark):
    rows = [("a", "u", at(0), at(0), "", True), ("b", "u", at(0), at(1), "", True), ("c", "u", at(0), at(1000), "", False)]
    s = spark.createDataFrame(rows, "session_id string, username string, created_at timestamp, last_activity timestamp, ip string, is_valid boolean")
    now = F.lit(at(1800)).cast("timestamp")
    assert [r.session_id for r in access.active_sessions(s, now).collect()] == ["b"]
    assert {r.session_id for r in access.cleanup(s, now).collect()} == {"b", "c"}
    fresh = access.refresh(s, "b", now)
    assert access.active_sessions(fresh, F.lit(at(3000)).cast("timestamp")).first().session_id == "b"
    assert access.active_sessions(access.invalidate(fresh, "b"), now).count() == 0
    events = spark.createDataFrame([(1, at(x), i) for i, x in enumerate((0, 1799, 3599, 5399.5))], "user_id int, ts timestamp, event_id int")
    assert sorted(r.n_events for r in access.sessionize(events).collect()) == [1, 1, 2]


def test_lru_k(spark):
    rows = [("a", at(1)), ("a", at(9)), ("b", at(2)), ("b", at(3)), ("c", at(8))]
    df = spark.createDataFrame(rows, "frame string, ts timestamp")
    now = F.lit(at(10)).cast("timestamp")
    assert {r.frame: r.distance for r in cache.backward_distance(df, now).collect()} == {"a": 9.0, "b": 8.0, "c": float("inf")}
    assert cache.victim(df, now).first().frame == "c"
    assert cache.victim(df, now, spark.createDataFrame([("c",)], "frame string")).first().frame == "a"


def test_fvecs(spark, tmp_path):
    path = str(tmp_path / "v.fvecs")
    rows = np.arange(40, dtype=np.float32).reshape(10, 4)
    fvecs.write(path, rows)
    assert fvecs.estimate(path) == (4, 10)
    assert [r.vector for r in fvecs.load(spark, path).orderBy("key").collect()] == rows.tolist()
    assert fvecs.load(spark, path, "doc", 3).count() == 3
    fvecs.RANGE_BYTES, kept = 40, fvecs.RANGE_BYTES
    try:
        assert [r.vector for r in fvecs.load(spark, path).orderBy("key").collect()] == rows.tolist()
    finally:
        fvecs.RANGE_BYTES = kept
    with open(path, "ab") as f:
        f.write(np.array([3], "<u4").tobytes() + bytes(16))  # another dimension
        f.write(b"\x04\0\0\0ab")  # cut off
    assert fvecs.load(spark, path).count() == 10
    (tmp_path / "empty.fvecs").write_bytes(b"")
    assert fvecs.load(spark, str(tmp_path / "empty.fvecs")).count() == 0
    whole = str(tmp_path / "w.ivecs")
    (np.array([[2, 7, 8]], "<i4")).tofile(whole)
    assert spark.read.format("ivecs").load(whole).first().vector == [7, 8]


def test_generators(spark):
    v = generate.vectors(spark, 20, 5, 2.0)
    rows = [r.vector for r in v.collect()]
    assert all(len(x) == 5 and max(map(abs, x)) <= 2 for x in rows) and len({tuple(x) for x in rows}) == 20
    assert generate.entries(spark, 3, "k").collect()[2] == ("k_2", "value_2")


def test_rate_of_a_counter_that_began_anew(spark):
    rows = [("c", at(x), float(v)) for x, v in ((0, 10), (10, 30), (20, 5), (30, 9))]
    series = spark.createDataFrame(rows, "name string, ts timestamp, value double")
    assert metrics.rate(series, 3600).first().rate == pytest.approx((20 + 5 + 4) / 3600)
