"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words. Every word covered by a window whose words also start anywhere else
(another text, or elsewhere in the same one) is removed; windows are judged on the input as it is.

1. Each window has an anchor: the leftmost smallest hash of its PHRASE-word phrases. Consecutive windows with one
   anchor in one place are a segment. Equal windows have equal anchors, so a segment whose anchor occurs once
   can be left alone; the smallest text that has an anchor owns it.
2. Candidate passages: a segment seen twice as a whole, and where an anchor has different segments, their windows seen
   in two of them. So far by keyed hashes, in aggregates with map-side combining.
3. A candidate is taken, as words, from one text that has it, and goes to the shard of its anchor's owner. All
   texts are cut to the parts that can hold a passage (segments whose anchor occurs twice) and these go to the
   shards of their anchors' owners: passages copied together are looked for together. An owner of very many parts
   has shards of its own, each with all its passages and a share of the parts.
4. A shard compiles its passages to Aho-Corasick automata over word numbers and streams the parts through them.
   A match, word for word, in any place but the one the passage was taken from confirms it: both places are
   removed. What isn't matched stays, whatever the hashes said.

Texts are dealt to buckets once; candidates, routes and matches join them there without shuffling texts again.
No step carries pairs of a group, so passages shared by any number of texts cost in proportion to their occurrences.

Defined results: null text and text without words have no word and an empty kept text; texts shorter than
a window lose nothing; equal rows are occurrences of their own, so they lose all their windows; an empty
table gives an empty result; other columns pass through unchanged. Whole texts count.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.llm.common import dealt, discard, fresh, written
from tessera.schema import extended

WINDOW, PHRASE = 35, 8
#: Words of passages in an automaton, parts of texts in a shard, and bytes of texts in a bucket, in the mean.
SHARD_WORDS, SHARD_PARTS, BUCKET_BYTES = 400_000, 20_000, 8 << 20
_KEY = "_passage_key"
_ROUTED = "shard long, kind int, key long, place long, body binary"


class Segments:
    """The segments of a slice of texts: first window, number of windows, anchor, hash of all its words."""

    def __init__(self, column: pa.Array, window: int = WINDOW, phrase: int = PHRASE):
        self.words = w = tk.Words(column)
        self.window = window
        self._hashes: np.ndarray | None = None
        n = len(w.starts)
        if n < window:
            self.start = self.size = self.text = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        low, have, span = tk.window_hash(w.hashes, phrase, 1), 1, window - phrase + 1
        place = np.arange(len(low), dtype=np.int32)
        while have < span:  # the leftmost smallest phrase of each window, by doubling
            step = min(have, span - have)
            later = low[step:] < low[:-step]
            low, place, have = np.where(later, low[step:], low[:-step]), np.where(later, place[step:], place[:-step]), have + step
        at = np.flatnonzero(w.whole(window)[: len(low)])
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
        begin = np.flatnonzero(fresh)
        self.start = at[begin]
        self.size = np.diff(np.append(begin, len(at)))
        self.anchor = low[self.start]
        self.text = np.searchsorted(w.first, self.start, side="right") - 1

    @property
    def hashes(self) -> np.ndarray:
        """Of every window."""
        if self._hashes is None:
            self._hashes = tk.window_hash(self.words.hashes, self.window, 2)
        return self._hashes

    @property
    def content(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return tk.pair(tk.pair(self.hashes[self.start], self.hashes[self.start + self.size - 1]), self.size.astype(np.uint64))

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """First words of all windows of the chosen segments."""
        size = self.size[chosen]
        skip = np.cumsum(size) - size
        return np.repeat(self.start[chosen] - skip, size) + np.arange(int(size.sum()))


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row each is of; null lists are empty."""
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def _match(own: np.ndarray, own_rows: np.ndarray, asked: np.ndarray, asked_rows: np.ndarray) -> np.ndarray:
    """For each own value of a row the place of its like among those asked of the row, or -1."""
    if not len(own) or not len(asked):
        return np.full(len(own), -1)
    n = int(max(own_rows.max(), asked_rows.max())) + 1
    _, code = np.unique(np.concatenate([own.view(np.int64), asked]), return_inverse=True)
    mine, theirs = code[: len(own)] * n + own_rows, code[len(own) :] * n + asked_rows
    order = np.argsort(theirs, kind="stable")
    at = np.minimum(np.searchsorted(theirs[order], mine), len(order) - 1)
    return np.where(theirs[order][at] == mine, order[at], -1)


def _find_segments(texts: DataFrame, whole: bool) -> DataFrame:
    """key and anchor of every segment; whole: with content."""
    names = [_KEY, "anchor", "content"][: 3 if whole else 2]

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                s = Segments(part.column(1))
                columns = [pa.array(part.column(0).to_numpy()[s.text]), pa.array(s.anchor.view(np.int64))]
                if whole:
                    columns.append(pa.array(s.content.view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _find_windows(texts: DataFrame) -> DataFrame:
    """Windows of the segments (`asked`: contents) listed for a text, each different segment once."""

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                s = Segments(part.column(1))
                found = _match(s.content, s.text, *_listed(part.column(2)))
                _, once = np.unique(found, return_index=True)
                chosen = once[found[once] >= 0] if len(once) else once
                starts, size = s.windows(chosen), s.size[chosen]
                key = part.column(0).to_numpy()[np.repeat(s.text[chosen], size)]
                held = s.hashes[starts] if len(starts) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(s.anchor[chosen], size).view(np.int64)), pa.array(held.view(np.int64))], names=[_KEY, "anchor", "held"])

    return texts.mapInArrow(work, f"{_KEY} long, anchor long, held long")


def _shards(owners: np.ndarray, salts: np.ndarray, which: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of parts: one of n_shards, or for owners of many parts one (`which`, a number) of the owner's own."""
    own = tk.mix(owners.astype(np.uint64) + np.uint64(11))
    salt = which.astype(np.uint64) % salts.astype(np.uint64)
    hot = (tk.mix(own + salt) >> np.uint64(2) | np.uint64(1 << 62)).astype(np.int64)
    return np.where(salts > 1, hot, (own % np.uint64(n_shards)).astype(np.int64))


def _route(part: pa.RecordBatch, n_shards: int) -> pa.RecordBatch:
    """Passages (kind 0) and parts (kind 1) of texts for the shards they go to.

    part: key, text, contents to take as passages, windows to take as passages, and of the segments whose anchor
    recurs the contents, owners and numbers of shards.
    """
    s = Segments(part.column(1))
    w, key = s.words, part.column(0).to_numpy()
    raw = w.data.tobytes()
    route = _match(s.content, s.text, *_listed(part.column(4)))
    owners, salts = _listed(part.column(5))[0], _listed(part.column(6))[0]
    columns: list[list] = [[], [], [], [], []]

    def put(kind: int, shard: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        columns[0].append(shard)
        columns[1].append(np.full(len(shard), kind))
        columns[2].append(key[text])
        columns[3].append(first - w.first[text])
        columns[4].extend(raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[end - 1].tolist()))

    def put_passages(segment: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        copies = salts[route[segment]]
        at = np.repeat(np.arange(len(segment)), copies)
        which = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        seg = segment[at]
        put(0, _shards(owners[route[seg]], salts[route[seg]], which, n_shards), s.text[seg], first[at], end[at])

    routed = np.flatnonzero(route >= 0)
    if len(routed):
        found = _match(s.content[routed], s.text[routed], *_listed(part.column(2)))
        _, once = np.unique(found, return_index=True)
        whole = routed[once[found[once] >= 0]]
        put_passages(whole, s.start[whole], s.start[whole] + s.size[whole] + s.window - 1)
        asked, rows = _listed(part.column(3))
        if len(asked):
            some = routed[np.isin(s.text[routed], rows)]
            at, of = s.windows(some), np.repeat(some, s.size[some])
            found = _match(s.hashes[at], s.text[of], asked, rows)
            _, once = np.unique(found, return_index=True)
            once = once[found[once] >= 0] if len(once) else once
            put_passages(of[once], at[once], at[once] + s.window)
        shard = _shards(owners[route[routed]], salts[route[routed]], tk.mix(key[s.text[routed]].astype(np.uint64)) >> np.uint64(1), n_shards)
        order = np.lexsort((s.start[routed], shard, s.text[routed]))
        seg, shard = routed[order], shard[order]
        first, end, text = s.start[seg], s.start[seg] + s.size[seg] + s.window - 1, s.text[seg]
        new = np.ones(len(seg), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (shard[1:] != shard[:-1]) | (first[1:] > end[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(seg)) - 1
        put(1, shard[begin], text[begin], first[begin], end[last])
    names = [f.split()[0] for f in _ROUTED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds)), pa.array(columns[4], pa.binary())], names=names)


class Passages:
    """Automata, of about SHARD_WORDS words each, of passages given with the place they were taken from."""

    def __init__(self):
        self.taken: list[tuple[int, int, int]] = []  # key, first word, words
        self.confirmed: set[int] = set()
        self._codes: dict[bytes, int] = {}
        self._automata: list[ahocorasick.Automaton] = []
        self._words = SHARD_WORDS
        self._made = False

    def add(self, key: int, place: int, words: list[bytes]) -> None:
        if self._words >= SHARD_WORDS:
            self._automata.append(ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE))
            self._words = 0
        codes = self._codes
        if self._automata[-1].add_word(tuple([codes.setdefault(x, len(codes) + 1) for x in words]), len(self.taken)):
            self._words += len(words)
        self.taken.append((key, place, len(words)))

    def locate(self, key: int, place: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges of words of the text `key`, from its word `place` on, where a passage taken elsewhere occurs."""
        if not self._made:
            for a in self._automata:
                a.make_automaton()
            self._made = True
        known = self._codes.get
        numbers = tuple([known(x, 0) for x in words])
        out: list[tuple[int, int]] = []
        for automaton in self._automata:
            for at, i in automaton.iter(numbers):
                source, first, n = self.taken[i]
                end = place + at + 1
                if source != key or first != end - n:
                    self.confirmed.add(i)
                    out.append((end - n, end))
        return out

    def sources(self) -> list[tuple[int, int, int]]:
        """(key, first word, end) of the places that confirmed passages were taken from."""
        return [(k, a, a + n) for k, a, n in map(self.taken.__getitem__, sorted(self.confirmed))]


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _stream(batches):
    """Ranges to remove, from the rows of _ROUTED in order of shard and kind."""
    now, passages, out = None, Passages(), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=[_KEY, "first", "end"])

    for rows in batches:
        for shard, kind, key, place, body in zip(*(rows.column(i).to_pylist() for i in range(5))):
            if shard != now:
                out += passages.sources()
                now, passages = shard, Passages()
            if kind == 0:
                passages.add(key, place, body.split())
            else:
                out += [(key, a, b) for a, b in _joined(passages.locate(key, place, body.split()))]
        if out:
            yield batch()
            out = []
    out += passages.sources()
    if out:
        yield batch()


OUTPUTS = ("n_words", "n_removed", "kept_text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept_text (kept words joined by one space) of each text.

    Columns of these names in docs give way to them.
    """
    return _removed(docs.drop(*OUTPUTS), OUTPUTS)


def repeats(texts: DataFrame) -> DataFrame:
    """_KEY and the ranges (`first`, `end`: lists of words) to remove of each text that has any. texts: _KEY, text, dealt by _KEY."""
    # what a join reads is written before it, so that the join can split a key with very many rows
    twice = written(_find_segments(texts, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(_KEY).alias("owner")).where("n > 1").drop("n"), "twice")
    places = written(_find_segments(texts, True).join(twice, "anchor").select(_KEY, "anchor", "content", "owner"), "places")
    discard(twice)
    segments = written(places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(_KEY).alias(_KEY)), "segments")
    varied = written(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "varied")
    asked = written(segments.join(varied, "anchor").groupBy(_KEY).agg(F.collect_set("content").alias("asked")), "asked")
    windows = _find_windows(texts.join(asked.hint("shuffle_hash"), _KEY))
    recurring = written(windows.groupBy("anchor", "held").agg(F.count(F.lit(1)).alias("n"), F.min(_KEY).alias(_KEY)).where("n > 1").select(_KEY, "held"), "recurring")
    discard(asked)
    discard(varied)

    sizes = places.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.where(F.col("n") > SHARD_PARTS).select("owner", F.ceil(F.col("n") / SHARD_PARTS).cast("long").alias("salts")), "hot")
    whole = segments.where("n > 1")
    parts, words = places.count(), whole.count() * (WINDOW + 13) + recurring.count() * WINDOW
    n_shards = max(1, math.ceil(parts / SHARD_PARTS), math.ceil(words / SHARD_WORDS))
    none = F.lit(None).cast("long")
    routes = places.select(_KEY, "content", "owner").distinct().join(hot, "owner", "left")
    told = (
        routes.select(_KEY, none.alias("whole"), none.alias("held"), F.struct("content", "owner", F.coalesce("salts", F.lit(1)).alias("salts")).alias("route"))
        .unionByName(whole.select(_KEY, F.col("content").alias("whole")), allowMissingColumns=True)
        .unionByName(recurring.select(_KEY, "held"), allowMissingColumns=True)
    )
    told = told.groupBy(_KEY).agg(F.collect_list("whole").alias("whole"), F.collect_list("held").alias("held"), F.collect_list("route").alias("route"))
    told = written(told.select(_KEY, "whole", "held", *[F.col(f"route.{c}").alias(c) for c in ("content", "owner", "salts")]), "told")
    for df in (places, segments, recurring, hot):
        discard(df)

    def route(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield _route(part, n_shards)

    routed = texts.join(told.hint("shuffle_hash"), _KEY).select(_KEY, "text", "whole", "held", "content", "owner", "salts").mapInArrow(route, _ROUTED)
    found = routed.repartition("shard").sortWithinPartitions("shard", "kind", "key", "place").mapInArrow(_stream, f"{_KEY} long, first long, end long")
    gone = written(found.groupBy(_KEY).agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("r")).select(_KEY, "r.first", "r.end"), "gone")
    discard(told)
    return gone


def _removed(docs: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    columns = docs.columns
    own, spark = fresh("_own_key", columns), docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    n = max(1, min(-(-size // (1 << 20)), 3 * spark.sparkContext.defaultParallelism), -(-size // BUCKET_BYTES))
    source = dealt(docs.withColumn(own, F.monotonically_increasing_id()), own, n)
    texts = source.select(F.col(own).alias(_KEY), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone_key, first, end = (fresh(f"_gone_{c}", columns) for c in ("key", "first", "end"))
    gone = repeats(texts).select(F.col(_KEY).alias(gone_key), F.col("first").alias(first), F.col("end").alias(end))
    rows = source.join(gone.hint("shuffle_hash"), F.col(own) == F.col(gone_key), "left")
    schema = extended(docs.schema, **dict(zip(outputs, ("long", "long", "string"))))
    at = columns.index("text")

    def work(batches):
        names = schema.names
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *_cut(part.column(at), part.column(len(columns)), part.column(len(columns) + 1))], names=names)

    return rows.select(*[rows[c] for c in columns], first, end).mapInArrow(work, schema)


def _cut(column: pa.Array, first: pa.Array, end: pa.Array) -> list[pa.Array]:
    """Words, removed words and kept text of each text; first and end list the ranges to remove."""
    data, offsets = tk.text_buffers(column)
    raw = data.tobytes()
    counts, removed, kept = [], [], []
    for a, b, starts, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.to_pylist(), end.to_pylist()):
        words, out, at = raw[a:b].split(), [], 0
        for x, y in zip(starts or (), ends or ()):
            out += words[at:x]
            at = max(at, y)
        out = out + words[at:] if at else words
        counts.append(len(words))
        removed.append(len(words) - len(out))
        kept.append(b" ".join(out))
    return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with recurring passages taken out of text (and n_chars, if there, counted anew); columns as they are."""
    n_words, removed, kept = (fresh(f"_{c}", docs.columns) for c in OUTPUTS)
    done = _removed(docs, (n_words, removed, kept))
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    count = F.when(F.col(removed) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None
    return done.select(*[text.alias(c) if c == "text" else count.alias(c) if c == "n_chars" else done[c] for c in docs.columns])
