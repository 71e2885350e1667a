"""State from an ordered log of puts and deletes, and scans of the log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError, invalid

PUT, DELETE = "put", "delete"


def operations(spark: SparkSession, ops: Iterable[tuple[str, str, str | None]], first: int = 1) -> DataFrame:
    """A log of (op, key, value) in the given order."""
    rows = [(first + i, op, key, value) for i, (op, key, value) in enumerate(ops)]
    if any(op not in (PUT, DELETE) for _, op, _, _ in rows):
        raise invalid("an operation is put or delete")
    return spark.createDataFrame(rows, "seq long, op string, key string, value string")


def last_ops(log: DataFrame) -> DataFrame:
    """The last operation of each key. One aggregate with map-side combining; no sort of a key's history."""
    last = F.max_by(F.struct("op", "value", "seq"), "seq")
    return log.groupBy("key").agg(last.alias("last")).select("key", "last.op", "last.value", "last.seq")


def current_state(log: DataFrame) -> DataFrame:
    """key, value of all live keys: the last put of a key, unless a delete follows it."""
    return last_ops(log).where(F.col("op") == PUT).select("key", "value")


def tombstones(log: DataFrame) -> DataFrame:
    return last_ops(log).where(F.col("op") == DELETE).select("key", "seq")


def apply_batch(kv: DataFrame, batch: DataFrame) -> DataFrame:
    """kv after a batch (seq, op, key, value); the last operation on a key wins."""
    last = last_ops(batch)
    return kv.join(last.select("key"), "key", "left_anti").unionByName(last.where(F.col("op") == PUT).select("key", "value"))


def clear(log: DataFrame) -> DataFrame:
    """Deletes for all live keys, numbered after the log's end."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end")).first()["end"]
    return current_state(log).select(F.lit(end + 1).cast("long").alias("seq"), F.lit(DELETE).alias("op"), "key", F.lit(None).cast("string").alias("value"))


def counts(log: DataFrame) -> DataFrame:
    """Puts, deletes, live keys and deleted keys."""
    of_key = log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("p"), F.count_if(F.col("op") == DELETE).alias("d"), F.max_by("op", "seq").alias("last"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return of_key.agg(total("p").alias("n_puts"), total("d").alias("n_deletes"), F.count_if(F.col("last") == PUT).alias("n_live"), F.count_if(F.col("last") == DELETE).alias("n_deleted"))


def put_vectors(vectors: DataFrame, new: DataFrame, dimension: int, on_conflict: str = "update") -> DataFrame:
    """vectors with new ones (key, vector); checks their dimension, and with on_conflict="error" that keys are new."""
    if on_conflict not in ("update", "error"):
        raise invalid("on_conflict is update or error")
    if new.where(F.size("vector") != dimension).limit(1).count():
        raise invalid(f"vectors must have dimension {dimension}")
    if on_conflict == "error" and new.join(vectors, "key", "left_semi").limit(1).count():
        raise EngineError("ALREADY_EXISTS", "a key has a vector already")
    return vectors.join(new, "key", "left_anti").unionByName(new)


def wal_forward(wal: DataFrame, start: int = 0) -> DataFrame:
    return wal.where(F.col("lsn") >= start).orderBy("lsn")


def wal_backward(wal: DataFrame, start: int | None = None) -> DataFrame:
    rows = wal if start is None else wal.where(F.col("lsn") <= start)
    return rows.orderBy(F.desc("lsn"))


def wal_record(wal: DataFrame, lsn: int) -> DataFrame:
    return wal.where(F.col("lsn") == lsn)


def numbered(ops: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """ops with lsn, rising in `order` and unique; gaps between partitions are allowed, as for any log sequence."""
    return ops.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("lsn", F.monotonically_increasing_id() + first)
