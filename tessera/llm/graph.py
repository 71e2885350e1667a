"""Connected components of an edge table by alternating star contraction.

Each round is two aggregates and joins; a node of any degree is reduced by map-side minima, which are written
so that the join reads them by an exchange of its own and can split the edges of such a node. Rounds end when the edges stop changing; every round is written to the shared
folder, so neither lineage nor lost executors add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
    out = written(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "edges")
    discard(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    low = written(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
    moved = edges.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    discard(low)
    return out


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable."""
    now = edges.where("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = written(now, "edges")
    before = _mark(now)
    while before[0]:
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
