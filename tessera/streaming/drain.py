"""Running a stream over what there is now, and reading its result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in a local session without that setting, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that the stream gives for all data at hand. They are written as Parquet, each micro-batch once."""
    spark, folder = stream.sparkSession, checkpoint_dir(stream.sparkSession)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], stream.schema)
        raise
