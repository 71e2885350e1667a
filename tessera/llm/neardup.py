"""Near-duplicates by b-bit MinHash.

1. A text becomes the set of keyed 64-bit hashes of its 5-word shingles. K minima are taken; a band hash of ROWS
   minima names a bucket, and the low BITS bits of every minimum are packed into a signature.
2. Equal word sequences (by a 128-bit digest) make one class, of which one member goes on.
3. First the pairs of each member of a bucket and the bucket's smallest member (one a member and bucket): bit counts
   of signatures give the similarity, corrected for chance agreement, and pairs within MARGIN of the threshold are
   confirmed on their words. Components of these links bring families of near copies together at linear cost.
4. Only buckets that still hold several components go on. In each, whatever its size, members outside the smallest
   member's component are held against all by bit counts, in blocks; blocks are larger in a bucket with more than
   REFINE members, so that its rows are copied less often. Of pairs that come near and lie in different components a
   spanning forest is passed on; its trees are clusters, and within them, in blocks of bounded size, pairs of different
   components are compared on full sets. A spanning forest of their links is confirmed on the words.
5. Components of all links, joined to the classes, label every text.

A pair at the threshold shares none of the 32 buckets with probability (1 - .75**4)**32 = 5e-6, and falls
below the estimate's margin with less than 1e-6. Above the threshold both are rarer still. A shared bucket is enough,
however many members it has.

Defined results: null text and text without words have the empty set and are linked with nothing; a text
of fewer words than a shingle has its whole word sequence for its set; rows that share a doc_id are one
node; null doc_id has the null component and is kept; an empty table gives an empty result. Whole texts count.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.llm.common import dealt, fresh, row_key, written
from tessera.llm.graph import components

SHINGLE, ROWS, BANDS, BITS = 5, 4, 32, 4
K = ROWS * BANDS
BLOCK, BLOCK_BYTES = 128, 24 << 20
GRID, REFINE = 512, 4096
MARGIN = 0.2
BUCKET_BYTES = 8 << 20

_random = np.random.Generator(np.random.PCG64(90210))
_TURNS = _random.integers(1, 2**31, K, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, K, dtype=np.uint32)


def _shingles(words: tk.Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, number) of the shingles, sorted; numbers are those of all runs of SHINGLE words."""
    at = np.flatnonzero(words.whole(SHINGLE))
    keys, text = numbers[at] if len(at) else numbers[:0], words.text_of()[at]
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return text[fresh], keys[fresh]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other; and len + 1 offsets.

    Texts of fewer words than a shingle have none: they equal only texts of their own class.
    """
    w = tk.Words(column, lower=True)
    text, keys = _shingles(w, tk.window_hash(w.hashes, SHINGLE))
    return keys, np.searchsorted(text, np.arange(len(column) + 1))


def minima(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minima of each set (rows of uint32); sets of no element get the largest value."""
    out = np.full((len(first) - 1, K), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    low = (keys >> np.uint64(32)).astype(np.uint32)
    for k in range(K):
        x = low * _TURNS[k] + _SHIFTS[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[full, k] = np.minimum.reduceat(x, first[full])
    return out


def signatures(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, K * BITS / 8 bytes a row: the lowest bits of all minima, then the next ones."""
    return np.concatenate([np.packbits((mins >> np.uint32(i) & np.uint32(1)).astype(np.uint8), axis=1) for i in range(BITS)], axis=1)


def band_hashes(mins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mins), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        out = tk.mix(out + mins[:, i::ROWS].astype(np.uint64) + np.uint64(i + 1))
    return tk.mix(out + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as binary values."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


SKETCH = "node long, doc long, n_shingles long, content binary, bands array<long>, signature binary"


def sketch(rows: DataFrame) -> DataFrame:
    """SKETCH of rows (node, doc, text). content: a 128-bit digest of the word sequence, null without words; bands
    and signature are null for texts of fewer words than a shingle."""

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                column = part.column(2)
                keys, first = shingle_sets(column)
                n, sizes = part.num_rows, np.diff(first)
                data, offsets = tk.text_buffers(column)
                raw = data.tobytes().lower()  # of bytes, A to Z only
                content = []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    words = raw[a:b].split()
                    content.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    if words and not sizes[i]:
                        sizes[i] = 1
                long = np.diff(first) > 0
                mins = minima(keys, first)[long]
                places = np.concatenate([[0], np.cumsum(long * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(band_hashes(mins).view(np.int64).reshape(-1)), mask=pa.array(~long))
                signature = _fixed(signatures(mins)).take(pa.array(np.cumsum(long) - 1, mask=~long)) if long.any() else pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(content, pa.binary()), lists, signature], names=[f.split()[0] for f in SKETCH.split(", ")])

    return rows.select("node", "doc", "text").mapInArrow(work, SKETCH)


def _estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures (their last axis, uint64), chance agreement taken out."""
    width, apart = K // 64, 0
    for j in range(width):
        differ = left[..., j] ^ right[..., j]
        for i in range(1, BITS):
            differ |= left[..., i * width + j] ^ right[..., i * width + j]
        apart = apart + np.bitwise_count(differ)
    chance = 2.0**-BITS
    return ((K - apart.astype(np.int32)) / K - chance) / (1 - chance)


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of each signature of left with each of right, chance agreement taken out."""
    left, right = (np.ascontiguousarray(x).view(np.uint64) for x in (left, right))
    return _estimate(left[:, None], right[None])


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart until now."""
        p, q = self.root(x), self.root(y)
        self.parent[p] = q
        return p != q


def _near(packed: np.ndarray, sizes: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int, among: np.ndarray | bool = True) -> list[tuple[int, int]]:
    """Pairs of rows `left` and `right` in different parts whose signatures come near the threshold, nearest first.
    among: which pairs are looked at."""
    guess = similarity(packed[left], packed[right])
    a, b = sizes[left][:, None], sizes[right][None, :]
    fit = (100 * np.minimum(a, b) >= threshold * np.maximum(a, b)) & (guess >= threshold / 100 - MARGIN) & (parts[left][:, None] != parts[right][None, :]) & among
    i, j = np.nonzero(fit)
    order = np.argsort(-guess[i, j], kind="stable")
    return list(zip(left[i[order]].tolist(), right[j[order]].tolist()))


def links(packed: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between parts by rows `left` and `right` (indices), 100 J >= threshold."""
    sizes = np.array([len(s) for s in sets])
    forest, out = _Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, p in enumerate(parts.tolist()):
        forest.join(first.setdefault(p, i), i)
    for x, y in _near(packed, sizes, parts, left, right, threshold):
        if forest.root(x) == forest.root(y):
            continue
        s, t = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
        at = np.searchsorted(t, s)
        at[at == len(t)] = len(t) - 1
        both = int(np.count_nonzero(t[at] == s))
        if 100 * both >= threshold * (len(s) + len(t) - both):
            forest.join(x, y)
            out.append((x, y))
    return out


def confirm_pairs(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked, by their words. texts: node, text, dealt by node.

    The texts of b are fetched first, so that the join that reads them can split a b of very many pairs.
    """
    pairs = written(pairs, "pairs")
    # each side is fetched as written rows meet the dealt texts
    wanted = written(pairs.select(F.col("b").alias("node")).distinct(), "wanted")
    right = written(texts.join(wanted.hint("shuffle_hash"), "node").select(F.col("node").alias("b"), F.col("text").alias("right")), "right")
    left = texts.join(pairs.withColumnRenamed("a", "node").hint("shuffle_hash"), "node").select(F.col("node").alias("a"), "b", F.col("text").alias("left"))
    both = left.join(right, "b").select("a", "b", "left", "right")

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "left"):
                n = part.num_rows
                column = pa.concat_arrays([part.column(2), part.column(3)])
                w = tk.Words(column, lower=True)
                text, keys = _shingles(w, tk.window_codes(w.codes, SHINGLE))
                size = np.bincount(text, minlength=2 * n)
                found, times = np.unique((text % n) * (len(w.codes) + 1) + keys, return_counts=True)
                common = np.bincount(found[times > 1] // (len(w.codes) + 1), minlength=n)
                sound = 100 * common >= threshold * (size[:n] + size[n:] - common)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(sound & (common > 0)))

    return both.mapInArrow(work, "a long, b long")


def confirm(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of different parts within clusters. members: node, cluster, part, signature, n_shingles.

    A cluster has so many blocks that each holds about BLOCK members and BLOCK_BYTES of sets at most; a pair of
    blocks is what a task holds in memory.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n_shingles")).alias("bytes")).where("size > 1")
    sizes = written(sizes.select("cluster", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
    placed = written(members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    rows = texts.join(placed.hint("shuffle_hash"), "node").select("node", "cluster", "part", "signature", "blocks", "block", "text")

    def make_sets(batches):
        names = ["node", "cluster", "part", "signature", "blocks", "block", "elements"]
        for batch in batches:
            for part in tk.slices(batch, "text"):
                keys, first = shingle_sets(part.column(6))
                elements = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays([*part.columns[:6], elements], names=names)

    held = rows.mapInArrow(make_sets, "node long, cluster long, part long, signature binary, blocks int, block int, elements binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = held.withColumn("other", other).select("node", "cluster", "part", "signature", "block", "elements", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "node")

    def compare(batches):
        for group in groups(batches, ["cluster", "low", "high"]):
            ids, parts = group.column("node").to_numpy(), group.column("part").to_numpy()
            packed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
            block, low, high = group.column("block").to_numpy(), group.column("low")[0].as_py(), group.column("high")[0].as_py()
            found = links(packed, sets, parts, np.flatnonzero(block == low), np.flatnonzero(block == high), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(c)]) for c in zip(*found)], names=["a", "b"])

    return confirm_pairs(dealt.mapInArrow(compare, "a long, b long"), texts, threshold)


def _leader_pairs(classes: DataFrame, threshold: int) -> DataFrame:
    """(a, b): members of buckets with the smallest member of theirs, where bit counts and sizes allow a link."""
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    # aggregates are written before the join that reads them, so that it can split a hot key
    leaders = written(buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader"), "leaders")
    pairs = written(buckets.join(leaders, "bucket").where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "near")
    side = lambda x, y: classes.select(F.col("node").alias(x), F.col("signature").alias(y), F.col("n_shingles").alias(f"{y}_n"))
    # the side of the leaders last: it may be hot, and both of its inputs are plain exchanges
    both = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", "s", "t", "s_n", "t_n")

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(n, -1) for i in (2, 3))
                guess = _estimate(s, t)
                p, q = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                fit = (100 * np.minimum(p, q) >= threshold * np.maximum(p, q)) & (guess >= threshold / 100 - MARGIN)
                yield batch.select(["a", "b"]).filter(pa.array(fit))

    return both.mapInArrow(work, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (group, node, part) of groups of three or more in several parts, with `out` (the row isn't in the part of
    the smallest node), and the numbers of rows (n) and of those out (n_out) of the group."""
    several = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min_by("part", "node").alias("main"), F.min("part").alias("low"), F.max("part").alias("high"))
    several = written(several.where("n > 2 and low != high").select("group", "n", "main"), "several")
    placed = written(rows.join(several, "group").withColumn("out", F.col("part") != F.col("main")).drop("main"), "placed")
    n_out = written(placed.where("out").groupBy("group").agg(F.count(F.lit(1)).alias("n_out")), "n_out")
    return placed.join(n_out, "group")


def mixed_groups(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """What bit counts must still be taken of: rows of _mixed for the buckets."""
    rows = classes.where("bands is not null").select("node", "bands").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    return _mixed(rows.select(F.explode("bands").alias("group"), "node", "part"))


def _forests(classes: DataFrame, mixed: DataFrame, threshold: int) -> DataFrame:
    """(a, b): forests of near pairs of different parts, of blocks of members out of the main part by members.

    A block has GRID members, in a group of n > REFINE sqrt(n / REFINE) times as many; a task takes it in pieces.
    """
    blocks = lambda n: F.ceil(F.col(n) / (GRID * F.sqrt(F.greatest(F.lit(1.0), F.col("n") / REFINE)))).cast("int")
    rows = mixed.join(classes.select("node", "signature", "n_shingles"), "node").withColumn("i", F.pmod(F.xxhash64("node"), blocks("n_out")).cast("int")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), blocks("n")).cast("int"))
    tall = rows.where("out").withColumn("j", F.explode(F.sequence(F.lit(0), blocks("n") - 1))).withColumn("side", F.lit(0))
    wide = rows.withColumn("i", F.explode(F.sequence(F.lit(0), blocks("n_out") - 1))).withColumn("side", F.lit(1))
    held = tall.unionByName(wide).select("group", "i", "j", "side", "node", "part", "n_shingles", "signature")
    held = held.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "node")

    def work(batches):
        for group in groups(batches, ["group", "i", "j"]):
            ids, parts, sizes = (group.column(c).to_numpy() for c in ("node", "part", "n_shingles"))
            packed = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            cut, n = int(np.count_nonzero(group.column("side").to_numpy() == 0)), len(ids)
            _, code = np.unique(ids, return_inverse=True)
            forest, found = _Forest(n), []
            for i in range(0, cut, BLOCK):
                for j in range(cut, n, GRID):
                    left, right = np.arange(i, min(i + BLOCK, cut)), np.arange(j, min(j + GRID, n))
                    trees = [np.array([forest.root(c) for c in code[side].tolist()]) for side in (left, right)]
                    for x, y in _near(packed, sizes, parts, left, right, threshold, trees[0][:, None] != trees[1]):
                        if forest.join(int(code[x]), int(code[y])):
                            found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(c)]) for c in zip(*found)], names=["a", "b"])

    return held.mapInArrow(work, "a long, b long")


def groups(batches, keys: list[str]):
    """Tables of one group each; the input is sorted by the keys (integers)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        head = tuple(c[0] for c in columns)
        if rest and tuple(rest[-1].column(rest[-1].schema.get_field_index(k))[rest[-1].num_rows - 1].as_py() for k in keys) != head:
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with a unique number of each row, dealt by it."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    n = max(1, min(-(-size // (1 << 20)), 3 * docs.sparkSession.sparkContext.defaultParallelism), -(-size // BUCKET_BYTES))
    return dealt(docs.withColumn(key, F.monotonically_increasing_id()), key, n)


def _labels(rows: DataFrame, threshold: int) -> DataFrame:
    """node, doc, n_shingles, component of rows (node, doc, text) dealt by node. component: the smallest doc linked."""
    sketches = written(sketch(rows), "sketches")
    known = sketches.where("doc is not null and content is not null")
    best = F.min(F.struct("doc", "node", "n_shingles", "signature", "bands"))
    classes = written(known.groupBy("content").agg(best.alias("m")).select("content", "m.*"), "classes")
    texts, long = rows.select("node", "text"), classes.where("bands is not null").drop("content")
    found = written(confirm_pairs(_leader_pairs(long, threshold), texts, threshold), "links")
    # rows of one doc with different texts are one node
    several = known.groupBy("doc").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low != high").select("doc")
    owned = known.select("doc", "content").join(written(several, "several"), "doc").join(classes.select("content", "node"), "content").select("doc", "node")
    found = found.unionByName(owned.join(written(owned.groupBy("doc").agg(F.min("node").alias("b")), "least"), "doc").where("node != b").select(F.col("node").alias("a"), "b"))
    parts = written(components(found), "parts")
    mixed = written(mixed_groups(long, parts), "mixed")
    if not mixed.isEmpty():
        near = components(_forests(long, mixed, threshold)).withColumnRenamed("component", "cluster")
        members = long.select("node", "signature", "n_shingles").join(near, "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        more = written(confirm(written(members, "members"), texts, threshold), "more")
        if not more.isEmpty():
            parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "parts")
    linked = written(parts.join(classes.select("node", "doc"), "node").withColumnRenamed("doc", "own"), "linked")
    least = written(linked.groupBy("component").agg(F.min("own").alias("_component")), "least")
    label = linked.join(least, "component").select("node", "_component")
    of_class = written(classes.select("content", "node", "doc").join(label, "node", "left").select("content", F.coalesce("_component", "doc").alias("_component")), "label")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("_component", "doc"))
    return sketches.select("node", "doc", "n_shingles", "content").join(of_class, "content", "left").select("node", "doc", "n_shingles", component.alias("component"))


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every text; a link is 100 * J >= threshold."""
    rows = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")), "node")
    done = _labels(rows, threshold).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """One row of each group of near-duplicate texts, all columns as they are: the one of the smallest doc_id,
    null last, and among rows of one doc_id that of the smallest hash.

    Rows are compared by their texts, whatever their ids: repeated rows and rows of null doc_id are in the group of
    their text, and rows that share a doc_id but not a text are in groups of their own. Of rows without words one a
    doc_id stays; those of null doc_id as well are copies of nothing and stay.
    """
    row, rank = fresh("_row", docs.columns), fresh("_rank", docs.columns)
    # a node is a row, so equal rows are one member of a class
    numbered = _numbered(docs.withColumn(rank, row_key(*docs.columns)), row)
    found = _labels(numbered.select(F.col(row).alias("node"), F.col(row).alias("doc"), F.col("text").cast("string").alias("text")), threshold)
    ids = numbered.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("id"), F.col(rank).alias("rank"))
    kind = F.when(F.col("n_shingles") > 0, 0).when(F.col("id").isNotNull(), 1).otherwise(2)
    group = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.coalesce("id", "node"))
    best = F.min(F.struct(F.col("id").isNull(), "id", "rank", "node"))
    kept = ids.join(written(found, "found").hint("shuffle_hash"), "node").groupBy(kind.alias("kind"), group.alias("group")).agg(best.alias("best"))
    kept = written(kept.select(F.col("best.node").alias(row)), "kept")
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").drop(row, rank).select(*docs.columns)
