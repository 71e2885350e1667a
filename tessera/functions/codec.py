"""Binary form of vectors: dimension as unsigned 32 bits, then 32-bit floats, little-endian."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.schema import extended

LARGEST = 4096


def to_bytes(values) -> bytes:
    v = np.asarray(values, dtype="<f4")
    return np.uint32(len(v)).astype("<u4").tobytes() + v.tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    if len(data) < 4:
        raise EngineError("INVALID_ARGUMENT", "a vector needs 4 bytes at least")
    n = int(np.frombuffer(data, "<u4", 1)[0])
    if len(data) != 4 + 4 * n:
        raise EngineError("INVALID_ARGUMENT", f"{len(data)} bytes can't hold {n} elements")
    return np.frombuffer(data, "<f4", n, 4)


def looks_like_vector(value: Column) -> Column:
    """Whether a binary value has the length that its first four bytes call for."""
    n = (F.octet_length(value) - 4) / 4
    stated = sum((F.conv(F.hex(F.substring(value, i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(4)), F.lit(0))
    return F.coalesce((F.octet_length(value) >= 8) & (stated == n) & stated.between(1, LARGEST), F.lit(False))


def encode(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """df with `out`, the binary form of a vector column; null stays null."""
    schema, at = extended(df.schema, **{out: "binary"}), df.columns.index(column)

    def work(batches):
        for batch in batches:
            held = batch.column(at)
            made = [None if v is None else to_bytes(v) for v in held.to_pylist()] if held.null_count else _encode_plain(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


def _encode_plain(column: pa.Array) -> list[bytes]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return [to_bytes(v) for v in np.split(flat, ends[:-1])] if len(ends) else []


def decode(df: DataFrame, column: str, out: str = "vector") -> DataFrame:
    """df with `out`, the vector of a binary column; malformed values end the query with an error."""
    schema, at = extended(df.schema, **{out: "array<float>"}), df.columns.index(column)

    def work(batches):
        for batch in batches:
            made = [None if v is None else from_bytes(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema)


def render(value: Column, vector: Column | None = None) -> Column:
    """A value for display: `[vector dim=N] a,b,..` where vector is given, else the text."""
    text = value.cast("string")
    if vector is None:
        return text
    shown = F.concat(F.lit("[vector dim="), F.size(vector), F.lit("] "), F.concat_ws(",", F.transform(vector, lambda x: x.cast("string"))))
    return F.when(vector.isNotNull(), shown).otherwise(text)
