"""Media columns with content-defined payload chunking.

A text's bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit mono WAV file.
The samples are cut where a gear hash of the last 32 bytes has its low bits zero, so equal passages give
equal chunks wherever they lie. A chunk whose digest occurs once stays in its file's container; the others
are pooled, one copy of each, and containers list their digests in order. One pass writes containers and what goes
to the pool to the shared folder. Reading back takes stored files only: it joins containers to the pool, verifies
every chunk and puts the file together.

Which chunks to pool is asked of a Bloom filter of the digests that occur twice, of at most FILTER_BITS. It
only spares shuffles: a chunk it takes for shared by mistake is pooled too, and read back like the others. From
about FILTER_BITS / 12 shared chunks on (11 million) such mistakes, and with them the shuffled bytes, grow.

Defined results: null and empty text is a payload of 64 zeros; equal texts give equal values; an empty
table gives an empty result; other columns are not looked at. Whole texts are stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.llm.common import written

LEAST, MOST, MASK = 256, 4096, (1 << 10) - 1
UNIT, RATE, FILTER_BITS, SEEN = 64, 8000, 1 << 27, 100_000
CONTAINER = "doc_id long, content binary, n_bytes long, header binary, digests array<binary>, bodies array<binary>"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav_header(n: int) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def wav_samples(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit mono WAV file")
    (n,) = struct.unpack("<I", media[40:44])
    return media[44 : 44 + n]


def cut_places(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload; each has LEAST to MOST bytes but for a shorter last one."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    reach = 1
    while reach < 32:  # after each step h[i] rolls over the last 2 * reach bytes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    marks = np.flatnonzero(h & np.uint32(MASK << 21) == 0) + 1
    ends, at, k = [], 0, 0
    marks = marks.tolist()
    while n - at > LEAST:
        while k < len(marks) and marks[k] < at + LEAST:
            k += 1
        at = min(n, at + MOST, marks[k] if k < len(marks) else n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cut_places(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def feature(samples: bytes) -> str:
    """Mean, spread, sign changes about the mean and an octave histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    over = x > mean
    turns = int(np.count_nonzero(over[1:] != over[:-1]))
    bins = np.bincount(x >> 5, minlength=8)
    return f"mean={mean:.4f} var={square / len(x) - mean * mean:.4f} turns={turns} bins=" + ",".join(map(str, bins.tolist()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bloom filter (64-bit words) of the digests that occur twice or more; three places each."""

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                heads = [d[:8] for t in part.column(1).to_pylist() for d in map(digest, chunks(padded((t or "").encode())))]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(heads), np.int64))], names=["head"])

    twice = written(_texts(docs).mapInArrow(work, "head long").groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "shared")
    bits = min(FILTER_BITS, max(1 << 12, 1 << (12 * twice.count()).bit_length()))
    places = twice.select(F.explode(F.array(*[F.pmod(F.shiftright("head", s), F.lit(bits)) for s in (0, 20, 40)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def _held(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    found, bits = np.ones(len(heads), bool), np.int64(64 * len(words))
    for s in (0, 20, 40):
        p = (heads >> np.int64(s)) % bits
        found &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
    return found


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers (CONTAINER; a body is null where its chunk is pooled) and the pool (digest, body), as stored."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))  # FILTER_BITS at most
    schema = f"{CONTAINER}, digest binary, body binary"

    def contain(batches):
        pack, seen = zstandard.ZstdCompressor(1).compress, set()
        for batch in batches:
            for part in tk.slices(batch, "text"):
                payloads = [padded((t or "").encode()) for t in part.column(1).to_pylist()]
                own = [chunks(p) for p in payloads]
                digests = [[digest(c) for c in cs] for cs in own]
                heads = np.frombuffer(b"".join(d[:8] for ds in digests for d in ds), np.int64)
                pooled = iter(_held(shared.value, heads).tolist())
                bodies, pool = [], {}
                for cs, ds in zip(own, digests):
                    bodies.append([])
                    for c, d in zip(cs, ds):
                        if next(pooled):
                            bodies[-1].append(None)
                            if d not in seen:
                                if len(seen) >= SEEN:
                                    seen.clear()
                                seen.add(d)
                                pool[d] = pack(c)
                        else:
                            bodies[-1].append(pack(c))
                _, offsets = tk.text_buffers(part.column(1))
                n, m = part.num_rows, len(pool)
                whole = [
                    part.column(0), pa.array([digest(p) for p in payloads], pa.binary()), pa.array(np.diff(offsets)), pa.array([wav_header(len(p)) for p in payloads], pa.binary()),
                    pa.array(digests, pa.list_(pa.binary())), pa.array(bodies, pa.list_(pa.binary())),
                ]
                columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in whole]
                columns += [pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(x, pa.binary())]) for x in (list(pool), list(pool.values()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    media = written(_texts(docs).mapInArrow(contain, schema), "media")
    pool = written(media.where("digest is not null").groupBy("digest").agg(F.first("body").alias("body")), "pool")
    return media.where("digests is not null").drop("digest", "body"), pool


def _read(rows: DataFrame) -> DataFrame:
    """Features of whole containers; every chunk and the payload are held against their digests."""

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, content, n, header, digests, bodies in zip(*(c.to_pylist() for c in batch.columns)):
                parts = []
                for d, body in zip(digests, bodies, strict=True):
                    parts.append(unpack(body, max_output_size=MOST))
                    if digest(parts[-1]) != d:
                        raise ValueError(f"a chunk of document {doc} is damaged")
                media = header + b"".join(parts)
                payload = wav_samples(media)
                if digest(payload) != content:
                    raise ValueError(f"the payload of document {doc} is damaged")
                out.append((doc, n, len(payload), content.hex(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return rows.select("doc_id", "content", "n_bytes", "header", "digests", "bodies").mapInArrow(work, FEATURES)


def restore(containers: DataFrame, pool: DataFrame) -> DataFrame:
    """Features of all files, read back from containers and pool."""
    pooled = F.exists("bodies", lambda b: b.isNull())
    whole, partial = containers.where(~pooled), containers.where(pooled)
    listed = partial.select("content", F.explode(F.filter(F.arrays_zip("digests", "bodies"), lambda x: x["bodies"].isNull())["digests"]).alias("digest"))
    wanted = listed.distinct().join(pool, "digest")
    found = wanted.groupBy(F.col("content").alias("_content")).agg(F.map_from_entries(F.collect_list(F.struct(F.base64("digest"), "body"))).alias("found"))
    found = written(found, "found")  # so that the join can split a content that very many rows have
    filled = partial.join(found, F.col("content") == F.col("_content"))
    bodies = F.zip_with("digests", "bodies", lambda d, b: F.coalesce(b, F.element_at("found", F.base64(d))))
    return _read(whole).unionByName(_read(filled.withColumn("bodies", bodies)))
