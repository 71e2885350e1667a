"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D.
Those six are single bytes that occur in no multi-byte UTF-8 sequence, so words
are found on bytes.  Work goes in slices of bounded bytes; a longer text makes
a slice of its own.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_KEY = b"words of a text"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order. It isn't linear, so no relation between texts carries over to their hashes."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) ^ (b * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D)))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each span as binary values. Spans come in order and don't overlap."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    body = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value the place of its like in the array of distinct values, and that array. Exact."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def digests(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each large_binary value: its bytes as two numbers, paired, up to 16 bytes; else keyed BLAKE2."""
    data, offsets = text_buffers(distinct)
    n, size = len(distinct), np.diff(offsets)
    out = np.zeros(n, dtype=U64)
    short = np.flatnonzero(size <= 16)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.arange(16)
    held = padded[offsets[short][:, None] + at] * (at < size[short][:, None])
    both = np.ascontiguousarray(held.astype(np.uint8)).view("<u8")
    out[short] = pair(pair(both[:, 0] + U64(0x5BD1E9955BD1E995), both[:, 1]), size[short].astype(U64))
    raw = data.tobytes() if len(short) < n else b""
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = int.from_bytes(blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=8, key=_KEY).digest(), "little")
    return out


def _runs(level: np.ndarray, size: int, join) -> np.ndarray:
    """One number for each run of `size` numbers, from numbers of runs of 1, 2, 4 ... by join(left, right)."""
    n, have, at, rest, out = len(level) - size + 1, 1, 0, size, None
    if n <= 0:
        return level[:0]
    while rest:
        if rest & 1:
            piece = level[at : at + n]
            out, at = piece if out is None else join(out, piece), at + have
        rest >>= 1
        if rest:
            level, have = join(level[:-have], level[have:]), 2 * have
    return out


def window_hash(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `size` word hashes; shorter by size - 1 than words."""
    return _runs(mix(words + U64(salt)), size, pair)


def window_codes(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` word codes, the same for equal runs and no others (below 2**31 words)."""
    return _runs(words, size, lambda a, b: np.unique(a << 32 | b, return_inverse=True)[1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and len + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if big else np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in slices whose texts hold at most `limit` bytes, or one row."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word spans of the texts of a column, in order.

    starts, ends: byte spans; first: first word of each text (len + 1);
    hashes: a keyed 64-bit hash of each word; codes: an exact number of each word within the column. Both are
    made when asked for, with one look at each distinct word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffers(column)
        data, offsets = self.data, self.offsets
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            self.data = data = table[data]
        inside = IS_WORD[data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None
        self._codes: np.ndarray | None = None

    def _encode(self) -> None:
        if self._codes is None:
            self._codes, self._distinct = codes(spans(self.data, self.starts, self.ends))

    @property
    def codes(self) -> np.ndarray:
        self._encode()
        return self._codes

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._encode()
            self._hashes = digests(self._distinct)[self._codes] if len(self._codes) else np.zeros(0, dtype=U64)
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def whole(self, size: int) -> np.ndarray:
        """For each word whether a window of `size` words from it lies in its text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.starts)) + size <= last


def group_counts(keys: np.ndarray) -> np.ndarray:
    """For each element how many elements equal it."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back]


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions within `size` from a flagged position, of n positions in all."""
    at = np.flatnonzero(flags)
    steps = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + size, n), minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags (or numbers) over [first[i], first[i + 1])."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
