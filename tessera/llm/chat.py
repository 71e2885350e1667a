"""Chat formatting by columnar byte assembly.

Rows of a conversation, in order of turn, become one string:

    ### role:\\n text </turn>\\n   (no blanks around the text)

A backslash goes before each backslash, # and < of texts, and in roles before colons and line ends too,
so no text can hold a mark and reading back is exact. Segment lengths, cumulative offsets and scatter
indices come from numpy; headers and contents are copied into one preallocated Arrow buffer.

Defined results: null text and null role are empty; rows of null conv_id make one conversation; null turn
comes first; ties of turn go by role, then text; equal rows are turns of their own; an empty table gives
an empty result; other columns are left aside. A conversation is one result row, so it is held whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk

HEAD, COLON, TAIL = b"### ", b":\n", b"</turn>\n"
TRAINED_ROLE = b"assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, loss_from array<long>, loss_to array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
SLICE_BYTES = 8 << 20
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\<])*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _escaped(column: pa.Array, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the column with a backslash before every byte of marks."""
    data, offsets = tk.text_buffers(column)
    flag = np.isin(data, np.frombuffer(marks, np.uint8))
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(flag, out=shift[1:])
    out = np.empty(len(data) + int(shift[-1]), np.uint8)
    at = np.arange(len(data)) + shift[1:]
    out[at] = data
    out[at[flag] - 1] = ord("\\")
    return out, offsets + shift[offsets]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all turns, offset of each turn in it (len + 1), start and end of each content."""
    r, r_off = _escaped(role, b"\\#<:\n")
    t, t_off = _escaped(text, b"\\#<")
    n, r_len, t_len = len(r_off) - 1, np.diff(r_off), np.diff(t_off)
    fixed = len(HEAD) + len(COLON) + len(TAIL)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(r_len + t_len + fixed, out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    role_at = offsets[:-1] + len(HEAD)
    text_at = role_at + r_len + len(COLON)
    for at, what in ((offsets[:-1], HEAD), (role_at + r_len, COLON), (text_at + t_len, TAIL)):
        out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)
    out[np.arange(len(r)) + np.repeat(role_at - r_off[:-1], r_len)] = r
    out[np.arange(len(t)) + np.repeat(text_at - t_off[:-1], t_len)] = t
    return out, offsets, text_at, text_at + t_len


def _batch(rows: pa.Table) -> pa.RecordBatch:
    """One output row for each run of equal conv_id."""
    conv = rows.column("conv_id").combine_chunks()
    role, text = (rows.column(c).combine_chunks() for c in ("role", "text"))
    out, offsets, start, end = assemble(role, text)
    value, null = conv.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(conv.is_null())
    change = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
    first = np.concatenate([[0], change]).astype(np.int64)
    bounds = np.append(first, len(value))
    base = np.repeat(offsets[first], np.diff(bounds))
    trained = np.asarray(pa.compute.equal(role.fill_null(""), TRAINED_ROLE.decode()).fill_null(False))
    held = np.zeros(len(value) + 1, np.int64)
    np.cumsum(trained, out=held[1:])
    lists = held[bounds].astype(np.int32)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets[bounds].copy()), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(np.diff(bounds)), formatted.cast(pa.string()),
         pa.ListArray.from_arrays(pa.array(lists), pa.array((start - base)[trained])), pa.ListArray.from_arrays(pa.array(lists), pa.array((end - base)[trained]))],
        names=["conv_id", "n_turns", "formatted", "loss_from", "loss_to"],
    )


def _whole(batches):
    """Tables that end where a conversation ends; the input is sorted by conv_id."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        last = table.column("conv_id")[table.num_rows - 1]
        conv = table.column("conv_id")
        same = conv.is_null() if not last.is_valid else pa.compute.equal(conv, last).fill_null(False)
        cut = int(pa.compute.sum(pa.compute.cast(same, pa.int64())).as_py())
        if table.num_rows > cut:
            yield table.slice(0, table.num_rows - cut)
        rest = table.slice(table.num_rows - cut)
    if rest is not None and rest.num_rows:
        yield rest


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: formatted, and byte spans of it that the loss covers (loss_from, loss_to)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def work(batches):
        small = (part for batch in batches for part in tk.slices(batch, "text", SLICE_BYTES))
        for table in _whole(small):
            yield _batch(table)

    return rows.mapInArrow(work, SCHEMA)


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; refuses anything else."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def chat_digests(chats: DataFrame) -> DataFrame:
    """What formatted conversations say when read back, and what their loss mask covers."""

    def work(batches):
        for batch in batches:
            out = []
            for conv, text, begins, ends in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3))):
                raw = text.encode()
                turns = read_chat(text)
                loss = "".join(_ESCAPED.sub(r"\1", raw[a:b].decode()) for a, b in zip(begins, ends))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return chats.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(work, DIGESTS)
