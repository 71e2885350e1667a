"""What the operators share: reading tables, columns they need, shared storage."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []
_tables: list[str] = []


#: Rows in a batch between Spark and Python: texts of 10,000 rows, Spark's own number, take 35 MB and more, several
#: times over in both processes of each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_ROWS rows, unless another number than Spark's own has been chosen."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the whole cluster sees.

    Only in a local session (as in tests) where the setting is absent does a temporary folder stand in.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: Seconds after which settle() collects again, and when it last did.
SETTLE_S = 10
_settled = [0.0]


def settle(spark: SparkSession) -> bool:
    """Has the executors collect their garbage if that is SETTLE_S seconds ago; whether it did.

    A heap that has grown is only given back by a full collection, as are direct buffers and classes of old plans;
    over many steps executors would otherwise stay at the most that any step took. One task a core, so that all
    executors are likely to get one; results don't depend on it.
    """
    if time.monotonic() - _settled[0] < SETTLE_S:
        return False
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()
    _settled[0] = time.monotonic()
    return True


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there."""
    settle(df.sparkSession)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df, written to the shared folder as a table in n buckets of key, and read back.

    Joins on key (with written(), so that its side is a plain exchange) then don't shuffle its rows. Keys should be
    unique, so that no bucket is hot. The table has columns c0, c1 ... besides the key, so any names will do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dealt"
    name = f"tessera_{uuid.uuid4().hex}"
    rest = [c for c in df.columns if c != key]
    plain = df.select(F.col(key).alias("k"), *[df[c].alias(f"c{i}") for i, c in enumerate(rest)])
    n = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    plain.repartition(n, "k").write.bucketBy(n, "k").option("path", path).saveAsTable(name)
    _made.append(path)
    _tables.append(name)
    held = spark.table(name)
    return held.select(F.col("k").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)])


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    if (path := getattr(df, "_tessera_path", None)) in _made:
        _made.remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that written() made in this process. Call it when the operators' results have been
    written or collected; results not yet computed can't be read afterwards."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        _delete(spark, _made.pop())


def row_key(*columns: str):
    """A 64-bit key of a row's content. Equal rows share it; users must bear chance collisions."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
