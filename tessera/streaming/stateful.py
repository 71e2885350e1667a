"""Structured Streaming forms: state of an op-log, token buckets, sessions, windowed histograms.

State is kept per key in the state store; the transitions are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.access import TIMEOUT_MINUTES, sessionize
from tessera.operators.limiter import Bucket, step
from tessera.operators.metrics import bucket


def op_log_state(log: DataFrame) -> DataFrame:
    """Updates (key, seq, op, value) of a stream of operations: the latest of each key by seq, in update mode.

    An operation that comes after one with a higher seq changes nothing. State is one row a key.
    """

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        fresh = False
        for pdf in frames:
            row = pdf.loc[pdf["seq"].idxmax()]
            if held is None or int(row["seq"]) > held[0]:
                held, fresh = (int(row["seq"]), row["op"], row["value"]), True
        if fresh:
            state.update(held)
            yield pd.DataFrame({"key": [key[0]], "seq": [held[0]], "op": [held[1]], "value": [held[2]]})

    return log.groupBy("key").applyInPandasWithState(latest, "key string, seq long, op string, value string", "seq long, op string, value string", "update", GroupStateTimeout.NoTimeout)


def limiter_decisions(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """request_id, client, ts, allowed of a stream of requests (client, ts, request_id), in append mode.

    Within a micro-batch a client's requests go by (ts, request_id); a batch's requests of one client are
    gathered, so the trigger's size bounds memory.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        held = Bucket(*state.get) if state.exists else None
        allowed = []
        for at in pd.to_datetime(pdf["ts"]):
            held, passed = step(held, int(at.value // 1000), rate, burst)
            allowed.append(passed)
        state.update((held.tokens, held.updated))
        yield pd.DataFrame({"request_id": pdf["request_id"].to_numpy(), "client": [key[0]] * len(pdf), "ts": pdf["ts"].to_numpy(), "allowed": allowed})

    rows = requests.select("client", "ts", "request_id")
    out = f"request_id long, client {dict(rows.dtypes)['client']}, ts timestamp, allowed boolean"
    return rows.groupBy("client").applyInPandasWithState(decide, out, "tokens double, updated long", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", late: str = "10 minutes", timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    """user, started, ended, n_events of closed sessions. A gap of exactly the timeout ends a session, as in batch:
    the window is shorter by the smallest step of time."""
    gap = f"{timeout * 60 - 1} seconds 999 milliseconds 999 microseconds"
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended")).select(user, "started", "ended", "n_events")


def with_open_sessions(closed: DataFrame, events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    """closed (of sessions()) and, at the end of a stream, the sessions that were still open: those of the events
    after each user's last closed one."""
    last = closed.groupBy(F.col(user).alias("_user")).agg(F.max("ended").alias("_last"))
    rest = events.join(last, F.col(user).eqNullSafe(F.col("_user")), "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_user", "_last")
    return closed.select(user, "started", "ended", "n_events").unionByName(sessionize(rest, user, ts, tie, timeout).select(user, "started", "ended", "n_events"))


def windowed_histogram(observations: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """name, window_start, le, count of observations (name, ts, value) by window, once the watermark has passed it."""
    w = F.window("ts", every)
    return observations.withWatermark("ts", late).groupBy("name", w.alias("w"), bucket(F.col("value")).alias("le")).agg(F.count(F.lit(1)).alias("count")).select("name", F.col("w.start").alias("window_start"), "le", "count")


def apply_batches(log: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each micro-batch of the log to a table, marked with the batch's id.

    A batch that is run again overwrites its own folder, so each is there once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
