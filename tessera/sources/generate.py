"""Generated entries and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, n: int, prefix: str = "key") -> DataFrame:
    """prefix_i and value_i for i from 0."""
    i = F.col("id").cast("string")
    return spark.range(n).select(F.concat(F.lit(f"{prefix}_"), i).alias("key"), F.concat(F.lit("value_"), i).alias("value"))


def vectors(spark: SparkSession, n: int, dimension: int, reach: float = 1.0, seed: int = 42, prefix: str = "vec") -> DataFrame:
    """Uniform in [-reach, reach], four decimals; the same for the same seed and number of partitions."""
    one = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda x: F.round(F.rand(seed) * (2 * reach) - reach, 4).cast("float"))
    return spark.range(n).select(F.concat(F.lit(f"{prefix}_"), F.col("id").cast("string")).alias("key"), one.alias("vector"))
