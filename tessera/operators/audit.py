"""Audit trail: writing entries, and searching them newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import time_text

#: Names of the event types.
EVENT_TYPES = ("LOGIN", "LOGOUT", "LOGIN_FAILED", "PUT", "GET", "DELETE", "BATCH", "EXPORT", "CLEAR_DB", "CONFIG", "USER_CREATED", "USER_DEACTIVATED", "SESSION_EXPIRED", "UNAUTHORIZED")
#: Fixed value: entries that stay in the bounded view.
CACHE_ENTRIES = 10_000


def details(kind: Column, subject: Column) -> Column:
    """The text of an entry of each kind; subject is a key, a number of entries or an action."""
    return (
        F.when(kind == "LOGIN", F.lit("User logged in"))
        .when(kind == "LOGIN_FAILED", F.lit("Login failed"))
        .when(kind == "LOGOUT", F.lit("User logged out"))
        .when(kind.isin("PUT", "GET", "DELETE"), F.concat(kind, F.lit(" key: "), subject))
        .when(kind == "BATCH", F.concat(F.lit("Batch operation: "), subject, F.lit(" entries")))
        .when(kind == "EXPORT", F.concat(F.lit("Exported "), subject, F.lit(" entries")))
        .when(kind == "CLEAR_DB", F.concat(F.lit("Cleared database: "), subject, F.lit(" entries deleted")))
        .when(kind == "UNAUTHORIZED", F.concat(F.lit("Unauthorized: "), subject))
        .otherwise(subject)
    )


def event_name(kind: Column) -> Column:
    return F.when(kind.isin(*EVENT_TYPES), kind).otherwise(F.lit("UNKNOWN"))


def entries(events: DataFrame, *carried: str) -> DataFrame:
    """Audit entries of events (ts, kind, username, ip, subject, success), with carried columns."""
    kind = event_name(F.col("kind"))
    return events.select("ts", kind.alias("event_type"), "username", F.coalesce("ip", F.lit("")).alias("ip"), details(F.col("kind"), F.col("subject")).alias("details"), "success", *carried)


def recent(audit: DataFrame, n: int = 100, tie: str = "ts") -> DataFrame:
    """The last n entries, oldest of them first."""
    return audit.orderBy(F.desc("ts"), F.desc(tie)).limit(n).orderBy("ts", tie)


def by_user(audit: DataFrame, username: str, n: int = 100, tie: str = "ts") -> DataFrame:
    return audit.where(F.col("username") == username).orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def by_type(audit: DataFrame, event_type: str, n: int = 100, tie: str = "ts") -> DataFrame:
    return audit.where(F.col("event_type") == event_type).orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def in_range(audit: DataFrame, start, end, tie: str = "ts") -> DataFrame:
    """Entries of the closed interval, in order of time."""
    return audit.where(F.col("ts").between(start, end)).orderBy("ts", tie)


def counts(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "LOGIN_FAILED").alias("failed_logins"), F.count_if(F.col("event_type") == "UNAUTHORIZED").alias("unauthorized"))


def text_line() -> Column:
    outcome = F.when(F.col("success"), "SUCCESS").otherwise("FAILURE")
    return F.concat(F.lit("["), time_text(F.col("ts")), F.lit("] "), outcome, F.lit(" User:"), F.col("username"), F.lit(" IP:"), F.col("ip"), F.lit(" Details:"), F.col("details"))


def json_line() -> Column:
    return F.to_json(F.struct(time_text(F.col("ts")).alias("timestamp"), "success", "username", F.col("ip").alias("ip_address"), "details"))


def write(audit: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Appends entries, a folder a day; files end after rows_per_file rows."""
    audit.withColumn("date", F.to_date("ts")).write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(path)
