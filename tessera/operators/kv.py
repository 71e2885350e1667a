"""Reads of a key-value table (key, value): lookups, ranges, search, pages. Keys compare by bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import invalid
from tessera.functions.text import contains_folded


def get(kv: DataFrame, key: str) -> DataFrame:
    """The entry of a key, or no row; the equality is pushed to the scan."""
    return kv.where(F.col("key") == key)


def batch_get(kv: DataFrame, keys: DataFrame | Sequence[str]) -> DataFrame:
    """pos, key, value for each asked key in order, repeats included; value is null for a missing key."""
    if not isinstance(keys, DataFrame):
        keys = kv.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
    return keys.join(kv, "key", "left").select("pos", "key", "value").orderBy("pos")


def scan(kv: DataFrame, start: str, end: str, reverse: bool = False, limit: int = 0, keys_only: bool = False) -> DataFrame:
    """Entries with start <= key < end in key order; the limit (0: none) counts after reversing.

    keys_only empties the values, and the scan then doesn't read them.
    """
    if limit < 0:
        raise invalid("limit must not be negative")
    rows = kv.where((F.col("key") >= start) & (F.col("key") < end))
    if keys_only:
        rows = rows.select("key", F.lit("").alias("value"))
    rows = rows.orderBy(F.desc("key") if reverse else F.asc("key"))
    return rows.limit(limit) if limit else rows


def entries(kv: DataFrame) -> DataFrame:
    return kv.select("key", "value")


def search(kv: DataFrame, part: str) -> DataFrame:
    """Entries whose key or value holds part, whatever the case."""
    return kv.where(contains_folded(F.col("key"), part) | contains_folded(F.col("value"), part))


def page(kv: DataFrame, number: int = 1, size: int = 25, descending: bool = False) -> DataFrame:
    """A page, from 1, of entries in key order."""
    if number < 1 or size < 1:
        raise invalid("page and size start from 1")
    return kv.orderBy(F.desc("key") if descending else F.asc("key")).offset((number - 1) * size).limit(size)


def browse(kv: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries and vectors in one list (key, value, entry_type); a vector's value is its text."""
    shown = F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))
    return kv.select("key", "value", F.lit("kv").alias("entry_type")).unionByName(vectors.select("key", shown.alias("value"), F.lit("vector").alias("entry_type")))


def upsert(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """kv with the entries of changes in place of those of the same key."""
    return kv.join(changes, "key", "left_anti").unionByName(changes)


def delete_keys(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys, "key", "left_anti")
