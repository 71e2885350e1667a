"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

KV = "key string, value string"
VECTORS = "key string, vector array<float>"
OP_LOG = "seq long, op string, key string, value string"
WAL = "lsn long, txn_id long, prev_lsn long, type string, page_id int, offset long, length long, old binary, new binary"
AUDIT = "ts timestamp, event_type string, username string, ip string, details string, success boolean"
METRICS = "name string, type string, value double, ts timestamp"
USERS = "username string, roles array<string>, is_active boolean"
SESSIONS = "session_id string, username string, created_at timestamp, last_activity timestamp, ip string, is_valid boolean"


def extended(schema: StructType, **columns: str) -> StructType:
    """A new schema with more columns, given as name=type. (StructType.add changes a frame's own schema.)"""
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return StructType([*schema.fields, *more.fields])
