"""Roles of users, and sessions with their timeout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.text import micros

TIMEOUT_MINUTES = 30
DEFAULT_ROLE = "user"


def has_role(roles: Column, role: str) -> Column:
    return F.coalesce(F.array_contains(roles, role), F.lit(False))


def can_read(roles: Column) -> Column:
    return F.coalesce(F.arrays_overlap(roles, F.array(F.lit("user"), F.lit("admin"))), F.lit(False))


def can_write(roles: Column) -> Column:
    return can_read(roles)


def can_delete(roles: Column) -> Column:
    return has_role(roles, "admin")


def is_admin(roles: Column) -> Column:
    return has_role(roles, "admin")


def permissions(users: DataFrame) -> DataFrame:
    """username and what its roles allow."""
    roles = F.col("roles")
    return users.select("username", can_read(roles).alias("can_read"), can_write(roles).alias("can_write"), can_delete(roles).alias("can_delete"), is_admin(roles).alias("is_admin"))


def create_user(users: DataFrame, username: str, roles: list[str] | None = None) -> DataFrame:
    """users with one more; an error if the name is taken."""
    if users.where(F.col("username") == username).limit(1).count():
        raise EngineError("ALREADY_EXISTS", username)
    return users.unionByName(users.sparkSession.createDataFrame([(username, roles or [DEFAULT_ROLE], True)], "username string, roles array<string>, is_active boolean"))


def user_exists(users: DataFrame, username: str) -> bool:
    return users.where(F.col("username") == username).limit(1).count() > 0


def deactivate(users: DataFrame, username: str) -> DataFrame:
    return users.withColumn("is_active", F.col("is_active") & (F.col("username") != username))


def idle_minutes(last: Column, now: Column) -> Column:
    """Whole minutes since the last activity."""
    return F.floor((micros(now) - micros(last)) / 60_000_000)


def is_live(now: Column, timeout: int = TIMEOUT_MINUTES) -> Column:
    return F.col("is_valid") & (idle_minutes(F.col("last_activity"), now) < timeout)


def active_sessions(sessions: DataFrame, now: Column, timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    return sessions.where(is_live(now, timeout))


def cleanup(sessions: DataFrame, now: Column, timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    """sessions without those that have expired."""
    return sessions.where(idle_minutes(F.col("last_activity"), now) < timeout)


def refresh(sessions: DataFrame, session_id: str, now: Column, timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    """The session's last activity set to now, if it is live."""
    hit = (F.col("session_id") == session_id) & is_live(now, timeout)
    return sessions.withColumn("last_activity", F.when(hit, now).otherwise(F.col("last_activity")))


def invalidate(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.withColumn("is_valid", F.col("is_valid") & (F.col("session_id") != session_id))


def session_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return sessions.join(users, "username")


def sessionize(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", timeout: int = TIMEOUT_MINUTES) -> DataFrame:
    """user, session_no (from 1), n_events, started, ended; a gap of `timeout` whole minutes starts a session.

    A user's events are ordered in one task; sorting spills to disk, so their number isn't bound by memory.
    """
    order = Window.partitionBy(user).orderBy(ts, tie)
    new = F.coalesce(idle_minutes(F.lag(ts).over(order), F.col(ts)) >= timeout, F.lit(True))
    marked = events.withColumn("_new", new.cast("int"))
    numbered = marked.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
