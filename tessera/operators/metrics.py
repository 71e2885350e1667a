"""Counters, gauges, latency histograms, engine statistics and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in seconds; the last is +Inf.
BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, float("inf"))
#: Fixed value: bytes of a page.
PAGE_BYTES = 4096


def bucket(value: Column) -> Column:
    """The first bound that is not below value."""
    ladder = F.when(value <= BOUNDS[0], F.lit(BOUNDS[0]))
    for bound in BOUNDS[1:-1]:
        ladder = ladder.when(value <= bound, F.lit(bound))
    return ladder.otherwise(F.lit(BOUNDS[-1]))


def bounds(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(b,) for b in BOUNDS], "le double")


def histogram(observations: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """name, le, count of every bucket of every histogram; buckets without observations count 0."""
    seen = observations.where(F.col(value).isNotNull()).groupBy(name, bucket(F.col(value)).alias("le")).agg(F.count(F.lit(1)).alias("count"))
    grid = observations.select(name).distinct().select(name, F.explode(F.array(*[F.lit(b) for b in BOUNDS])).alias("le"))
    return grid.join(seen, [name, "le"], "left").select(name, "le", F.coalesce("count", F.lit(0)).alias("count"))


def cumulative(hist: DataFrame, name: str = "name") -> DataFrame:
    """name, le, cumulative: observations up to each bound. Ten rows a histogram go through the window."""
    order = Window.partitionBy(name).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(name, "le", F.sum("count").over(order).alias("cumulative"))


def sums(observations: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    return observations.groupBy(name).agg(F.count(value).alias("count"), F.sum(value).alias("sum"))


def counters(increments: DataFrame) -> DataFrame:
    """name, value: the sum of each counter's increments."""
    return increments.groupBy("name").agg(F.sum("value").alias("value"))


def gauges(settings: DataFrame) -> DataFrame:
    """name, value: the last setting by ts."""
    return settings.groupBy("name").agg(F.max_by("value", "ts").alias("value"))


def average_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def engine_stats(ops: DataFrame, kv: DataFrame) -> DataFrame:
    """Totals and mean latencies of operations (kind get or put, hit, micros), and live keys of kv.

    A get of a missing key counts neither as a get nor in the mean.
    """
    got, put = (F.col("kind") == "get") & F.col("hit"), F.col("kind") == "put"
    both = ops.select("kind", "hit", "micros", F.lit(0).alias("entry")).unionByName(kv.select(F.lit(None).cast("string").alias("kind"), F.lit(False).alias("hit"), F.lit(None).cast("double").alias("micros"), F.lit(1).alias("entry")))
    return both.agg(
        F.count_if(got).alias("total_gets"), F.count_if(put).alias("total_puts"),
        average_or_zero(F.when(got, F.col("micros"))).alias("avg_get_time_us"), average_or_zero(F.when(put, F.col("micros"))).alias("avg_put_time_us"),
        F.coalesce(F.sum("entry"), F.lit(0)).alias("total_entries"),
    )


def rate(series: DataFrame, seconds: int = 300) -> DataFrame:
    """name, window_start, rate: what a counter gains a second in each window of its samples (ts, value).

    A sample below the one before it means that the counter began anew, so all of it is gain.
    """
    rows = series.withColumn("w", F.window("ts", f"{seconds} seconds"))
    before = F.lag("value").over(Window.partitionBy("name", "w").orderBy("ts", "value"))
    gain = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return rows.withColumn("_gain", gain).groupBy("name", "w").agg((F.sum("_gain") / F.lit(float(seconds))).alias("rate")).select("name", F.col("w.start").alias("window_start"), "rate")


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def pool_stats(accesses: DataFrame) -> DataFrame:
    """hits, misses, flushed, evicted, hit_rate of buffer-pool events (kind)."""
    kinds = {k: F.count_if(F.col("kind") == k) for k in ("hit", "miss", "flush", "evict")}
    return accesses.agg(kinds["hit"].alias("hits"), kinds["miss"].alias("misses"), kinds["flush"].alias("flushed"), kinds["evict"].alias("evicted")).withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


def health(components: DataFrame) -> DataFrame:
    """status of components (name, ok): HEALTHY if all are, DEGRADED if `database` is, else UNHEALTHY."""
    all_ok = F.coalesce(F.every("ok"), F.lit(True))
    database = F.coalesce(F.bool_or(F.when(F.col("name") == "database", F.col("ok"))), F.lit(False))
    return components.agg(F.when(all_ok, "HEALTHY").when(database, "DEGRADED").otherwise("UNHEALTHY").alias("status"))


def storage_mb(pages: Column) -> Column:
    return pages * PAGE_BYTES / F.lit(1048576.0)


def bound_text(le: Column) -> Column:
    shown = F.when(le == F.floor(le), F.floor(le).cast("string")).otherwise(le.cast("string"))
    return F.when(le == F.lit(float("inf")), "+Inf").otherwise(shown)


def prometheus_lines(singles: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Exposition text, one line a row, with its place (name, part, le).

    singles: name, type (counter or gauge), value. observations: name, value of histograms, whose _sum
    is the sum of what was observed.
    """
    note = F.when(F.col("type") == "counter", "Total count").otherwise("Current value")
    whole = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), "name", note), F.concat_ws(" ", F.lit("# TYPE"), "name", "type"), F.concat_ws(" ", "name", whole))
    out = singles.select("name", F.posexplode(lines).alias("part", "line")).select("name", F.col("part").cast("int").alias("part"), F.lit(0.0).alias("le"), "line")
    if observations is None:
        return out
    cum = cumulative(histogram(observations)).select("name", F.lit(2).alias("part"), "le", F.concat(F.col("name"), F.lit('_bucket{le="'), bound_text(F.col("le")), F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
    total = sums(observations)
    rest = F.array(
        F.concat_ws(" ", F.lit("# HELP"), "name", F.lit("Latency distribution")), F.concat_ws(" ", F.lit("# TYPE"), "name", F.lit("histogram")), F.lit(None).cast("string"),
        F.concat(F.col("name"), F.lit("_count "), F.col("count").cast("string")), F.concat(F.col("name"), F.lit("_sum "), F.col("sum").cast("string")),
    )
    tail = total.select("name", F.posexplode(rest).alias("part", "line")).where("line is not null").select("name", F.col("part").cast("int").alias("part"), F.lit(0.0).alias("le"), "line")
    return out.unionByName(cum).unionByName(tail)
