"""Mixture-controlled packing by deficit round-robin.

Texts become token ids with an end id, and are dealt to shards of bounded size by a hash. In a shard every
source is a queue. Each window credits every source with its target share of tokens; sources are visited in
turn and serve tokens against their credit, and what a source lacks or has had too much is carried to the
next window. Where a shard's credits start is what the shards before it have had too little or too much of a source
against its share of all tokens, by counts of tokens, so deficits pass from partition to partition without one waiting
for another. A quarter of what a window owes a source is carried at most, so the shard's first window settles it and no
source is missing from a window for what other shards held.

A text is cut wherever a window or a turn ends. Windows are full; the rest of a shard goes to sequences of a
power of two each, so there is no padding at all.

Defined results: null and empty text is its end id alone; null source is a queue of its own; equal rows are
packed each, and more than COPIES of one go to several shards; an empty table gives an empty result. Whole texts are packed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bytebpe
from tessera.llm import textkernel as tk
from tessera.llm.common import written

WINDOW = 2048
SHARD_TOKENS = 2_000_000
SEQUENCES = 1 << 32
BUCKET, COPIES = 1024, 1000
SCHEMA = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, source, n and ids (compressed little-endian 32-bit) of every text."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"))

    def work(batches):
        enc = bytebpe.encoding(path)
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                counts, held = [], []
                for text in part.column(2).to_pylist():
                    ids = bytebpe.encode(enc, text) if text else []
                    ids.append(end_id)
                    counts.append(len(ids))
                    held.append(codec.compress(np.array(ids, dtype="<u4"), asbytes=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "source", "n", "ids"])

    return rows.mapInArrow(work, "doc_id long, source string, n long, ids binary")


def sizes(total: int, window: int) -> list[int]:
    """Lengths of the sequences that hold `total` tokens: full windows, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _quantum(rest: int, credit: list[float], shares: list[float]) -> float:
    """The x for which sources of credit + share * x > 0 are due `rest` tokens together; no credit is above 0."""
    total = owed = x = 0.0
    for level, share in sorted((-c / s, s) for c, s in zip(credit, shares)):
        if total and x <= level:
            break
        total, owed = total + share, owed + share * level
        x = (rest + owed) / total
    return x


def deal(queues: list[list[int]], lengths: list[int], shares: list[float], credit: list[float], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, sequence, offset). queues: rows of each source in order; shares: tokens a
    source is due of each token dealt; credit: tokens it is due at the start."""
    live = [i for i, q in enumerate(queues) if q]
    # what is carried in must balance, or the windows would never settle it
    over, whole = sum(credit[i] for i in live), sum(shares[i] for i in live) or 1.0
    credit = [c - over * s / whole for c, s in zip(credit, shares)]
    head, at = [0] * len(queues), [0] * len(queues)
    out: list[tuple[int, int, int, int, int]] = []
    turn = 0
    for sequence, size in enumerate(sizes(sum(lengths), window)):
        offset, idle = 0, 0
        for i in live:
            credit[i] += shares[i] * size
        while offset < size:
            if turn >= len(live):
                turn = 0
            i = live[turn]
            if credit[i] <= 0 and len(live) > 1:
                turn, idle = turn + 1, idle + 1
                if idle >= len(live):  # none is due anything: the rest of the window is shared out too
                    more = _quantum(size - offset, [credit[k] for k in live], [max(shares[k], 1e-12) for k in live])
                    for k in live:
                        credit[k] += max(shares[k], 1e-12) * more
                    idle = 0
                continue
            idle, due = 0, min(size - offset, math.ceil(credit[i])) if len(live) > 1 else size - offset
            queue = queues[i]
            while due and head[i] < len(queue):
                row = queue[head[i]]
                n = min(due, lengths[row] - at[i])
                out.append((row, at[i], n, sequence, offset))
                due, offset, credit[i] = due - n, offset + n, credit[i] - n
                at[i] += n
                if at[i] == lengths[row]:
                    head[i], at[i] = head[i] + 1, 0
            if head[i] == len(queue):
                live.pop(turn)
            elif offset < size:
                turn += 1
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, targets: dict[str, float] | None = None, others: float = 0.0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all texts in sequences, columns of SCHEMA.

    targets: weight of each source's tokens in a window, `others` that of each source not named; its own share of all
    tokens if there are no targets. A source is in every window as long as it has tokens in the shard.
    """
    spot = F.xxhash64("doc_id", "n", F.crc32("ids"))
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # not null, so that it can be joined
    held = written(tokenize(docs, path, end_id).withColumn("spot", spot).withColumn("queue", queue).withColumn("row", F.monotonically_increasing_id()), "tokens")
    copied = written(held.groupBy("spot").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > COPIES), "copied")
    if not copied.isEmpty():  # what so many equal rows share must not bring them to one shard
        held = held.join(copied, "spot", "left").withColumn("spot", F.when(F.col("copies").isNull(), F.col("spot")).otherwise(F.xxhash64("spot", "row")))
    held = held.select("doc_id", "source", "n", "ids", "spot", "queue")
    every = held.agg(F.sum("n").alias("t")).first()["t"] or 0
    n_shards = max(1, math.ceil(every / shard_tokens))
    shard = F.pmod("spot", F.lit(n_shards)).cast("int")
    counts = written(held.groupBy(shard.alias("shard"), "queue").agg(F.sum("n").alias("tokens")), "counts")
    totals = counts.groupBy("queue").agg(F.sum("tokens").alias("all_tokens"))
    if targets:
        known = F.create_map(*[x for k, v in sorted(targets.items()) for x in (F.lit(f"={k}"), F.lit(float(v)))])
        weight = F.coalesce(F.try_element_at(known, F.col("queue")), F.lit(float(others)))
    else:
        weight = F.col("all_tokens").cast("double")
    whole = totals.agg(F.sum(weight).alias("w")).first()["w"] or 1.0
    shares = totals.select("queue", (weight / F.lit(whole)).alias("share"), (F.col("all_tokens") / F.lit(max(1, every))).alias("own_share"))
    of_shard = counts.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    dealt_before = _before(of_shard, [], "shard_tokens", "dealt")
    served_before = _before(counts, ["queue"], "tokens", "served")
    most, open_ = F.col("share") * (window / 4), F.col("own_share") * F.col("dealt") - F.col("served")
    credits = served_before.join(shares, "queue").join(dealt_before, "shard").select("shard", "queue", "share", F.greatest(F.least(open_, most), -most).alias("credit"))

    def fill(key, tokens: pa.Table, due: pa.Table) -> pa.Table:
        order = sorted(range(tokens.num_rows), key=lambda k: rank[k]) if (rank := _rank(tokens)) else []
        doc, source, queue_of, counts, ids = (tokens.column(c).to_pylist() for c in ("doc_id", "source", "queue", "n", "ids"))
        named = sorted(zip(due.column("queue").to_pylist(), due.column("share").to_pylist(), due.column("credit").to_pylist()))
        index = {s: i for i, (s, _, _) in enumerate(named)}
        queues: list[list[int]] = [[] for _ in named]
        for k in order:
            queues[index[queue_of[k]]].append(k)
        pieces = deal(queues, counts, [x[1] for x in named], [x[2] for x in named], window)
        size = sizes(sum(counts), window)
        codec, now, flat, out = pa.Codec("zstd", 1), -1, b"", []
        pieces.sort(key=lambda p: (p[0], p[1]))
        for row, start, n, _, _ in pieces:
            if row != now:
                now, flat = row, codec.decompress(ids[row], 4 * counts[row], asbytes=True)
            out.append(flat[4 * start : 4 * (start + n)])
        base = (key[0].as_py() if hasattr(key[0], "as_py") else key[0]) * SEQUENCES
        columns = [
            pa.array([doc[p[0]] for p in pieces], pa.int64()), pa.array([source[p[0]] for p in pieces], pa.string()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([counts[p[0]] for p in pieces], pa.int64()), pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()), pa.array([size[p[3]] for p in pieces], pa.int64()), pa.array(out, pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    dealt = held.withColumn("shard", shard).withColumn("spot", F.xxhash64("spot", F.lit("order")))
    return dealt.groupBy("shard").cogroup(credits.groupBy("shard")).applyInArrow(fill, SCHEMA)


def _before(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with `out`, the sum of value over the smaller shards of the same keys.

    Sums run within buckets of BUCKET shards and over buckets, so no window holds more than a key's buckets.
    """
    bucketed = rows.withColumn("bucket", F.floor(F.col("shard") / BUCKET))
    inner = Window.partitionBy(*keys, "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = bucketed.groupBy(*keys, "bucket").agg(F.sum(value).alias("_sum")).withColumn("_outer", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    within = bucketed.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(buckets, [*keys, "bucket"]).withColumn(out, F.col("_inner") + F.col("_outer")).drop("bucket", "_inner", "_outer")


def _rank(tokens: pa.Table) -> list:
    """A fixed order of a shard's rows, whatever order they come in."""
    return list(zip(tokens.column("spot").to_pylist(), [(x is not None, x or 0) for x in tokens.column("doc_id").to_pylist()], tokens.column("ids").to_pylist()))
