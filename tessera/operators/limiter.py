"""Token-bucket decisions per client, in batch; the stream shares the transition.

A client's first request makes a full bucket and passes without taking a token. Later ones refill by rate
and elapsed time up to burst, and pass if a token is left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import micros
from tessera.schema import extended


@dataclass
class Bucket:
    tokens: float
    updated: int  # microseconds


def step(bucket: Bucket | None, at: int, rate: float, burst: float) -> tuple[Bucket, bool]:
    """The bucket after a request at a time in microseconds, and whether the request passes."""
    if bucket is None:
        return Bucket(burst, at), True
    tokens = min(burst, bucket.tokens + max(0, at - bucket.updated) / 1e6 * rate)
    passed = tokens >= 1.0
    return Bucket(tokens - 1.0 if passed else tokens, at), passed


def _decide(requests: DataFrame, keys: list[str], ts: str, tie: str, rate: Column, burst: Column) -> DataFrame:
    """requests with `allowed` and `tokens` left of the bucket of their keys.

    Requests are dealt by their keys and sorted, and a task carries a bucket from batch to batch: no client is
    ever held in memory.
    """
    rows = requests.withColumn("_at", micros(ts)).withColumn("_rate", rate.cast("double")).withColumn("_burst", burst.cast("double"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, ts, tie)
    schema = extended(requests.schema, allowed="boolean", tokens="double")

    def work(frames):
        bucket, now = None, ()
        for pdf in frames:
            allowed, left = np.zeros(len(pdf), bool), np.zeros(len(pdf))
            owners = zip(*(pdf[k].astype(object).where(pdf[k].notna(), None).tolist() for k in keys))
            for i, (who, at, per_second, most) in enumerate(zip(owners, pdf["_at"].tolist(), pdf["_rate"].tolist(), pdf["_burst"].tolist())):
                if who != now:
                    bucket, now = None, who
                bucket, allowed[i] = step(bucket, at, per_second, most)
                left[i] = bucket.tokens
            yield pdf.drop(columns=["_at", "_rate", "_burst"]).assign(allowed=allowed, tokens=left)

    return rows.mapInPandas(work, schema)


def decisions(requests: DataFrame, rate: float, burst: float, client: str = "client", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """requests with `allowed` and `tokens` left."""
    return _decide(requests, [client], ts, tie, F.lit(rate), F.lit(burst))


def by_endpoint(requests: DataFrame, limits: dict[str, tuple[float, float]], default: tuple[float, float] = (100.0, 200.0)) -> DataFrame:
    """Decisions of a limiter for each endpoint (its rate and burst in limits); others share `_default`.

    All limiters work in one pass, each client having a bucket in each of them.
    """
    known = F.col("endpoint").isin(*limits) if limits else F.lit(False)
    routed = requests.withColumn("limiter", F.when(known, F.col("endpoint")).otherwise(F.lit("_default")))
    rate, burst = (F.lit(float(default[i])) for i in (0, 1))
    for name, limit in limits.items():
        rate, burst = (F.when(F.col("limiter") == name, float(limit[i])).otherwise(x) for i, x in ((0, rate), (1, burst)))
    return _decide(routed, ["limiter", "client"], "ts", "request_id", rate, burst)


def tokens_left(decided: DataFrame, client: str = "client", ts: str = "ts") -> DataFrame:
    """client, tokens after its last request, without a refill."""
    return decided.groupBy(client).agg(F.max_by("tokens", ts).alias("tokens"))


def stats(decided: DataFrame, by: list[str] | None = None, client: str = "client") -> DataFrame:
    """Clients, requests, allowed, denied and the share allowed in percent (100 without requests)."""
    grouped = decided.groupBy(*by) if by else decided.groupBy()
    return grouped.agg(
        F.countDistinct(client).alias("clients"), F.count(F.lit(1)).alias("total"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied")
    ).withColumn("allow_rate", F.coalesce(F.try_divide(F.lit(100.0) * F.col("allowed"), F.col("total")), F.lit(100.0)))
