"""Cache analysis: which frame an LRU-K replacer would give up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import micros

K = 2


def backward_distance(accesses: DataFrame, now, k: int = K, frame: str = "frame", ts: str = "ts") -> DataFrame:
    """frame, distance in seconds from now back to its k-th last access; infinite with fewer accesses.

    Each task passes on k rows a frame at most before the exchange, so frames with very many accesses are cut down first.
    """
    times = accesses.groupBy(frame).agg(F.count(F.lit(1)).alias("n_accesses"))
    order = Window.partitionBy(frame).orderBy(F.desc(ts))
    kth = accesses.select(frame, ts).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).where(F.col("_r") == k).select(frame, F.col(ts).alias("_kth"))
    distance = (micros(now) - micros("_kth")) / F.lit(1e6)
    return times.join(kth, frame, "left").select(frame, "n_accesses", F.coalesce(distance, F.lit(float("inf"))).alias("distance"))


def victim(accesses: DataFrame, now, pinned: DataFrame | None = None, k: int = K, frame: str = "frame", ts: str = "ts") -> DataFrame:
    """The unpinned frame of the largest distance; of equals the smaller frame."""
    rows = backward_distance(accesses, now, k, frame, ts)
    if pinned is not None:
        rows = rows.join(pinned, frame, "left_anti")
    return rows.orderBy(F.desc("distance"), frame).limit(1)


def evictable(frames: DataFrame) -> DataFrame:
    return frames.where("pin_count = 0")
