"""Language identification with language-bitmask n-gram filters.

A Bloom filter per language is stored bit-sliced: one word per slot, one bit of it per language, so the
AND of the words at an n-gram's slots names every language that may contain it. For a text the bits are
counted by language, corrected for each filter's false positives, and the largest share decides.

Defined results: `und` with score 0 for null text, text without a letter, and where nothing could be
learned; a text with letters but without n-grams gets the most frequent learned language with score 0;
ties go to the more frequent, then the smaller name; equal rows get equal results; an empty table gives an
empty result. Texts are taken whole. A null doc_id is neither learned from nor held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk

GRAM, HASHES, SLOTS = 4, 2, 1 << 20
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of letters, with word edges as blanks, as integers; and the text each is of."""
    data, offsets = tk.text_buffers(column)
    n = len(offsets) - 1
    folded = _FOLD[data]
    if len(folded) > 1:
        capital = (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97) & (folded[:-1] == 0xC3)
        folded[1:][capital] += 0x20
    # each text gets a blank on both sides
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    padded = np.full(len(data) + 2 * n, 0x20, dtype=np.uint8)
    padded[at] = folded
    if len(padded) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    key = np.zeros(len(padded) - GRAM + 1, dtype=np.uint32)
    for i in range(GRAM):
        key |= padded[i : len(padded) - GRAM + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    blank = padded == 0x20
    sound = ~blank[1 : len(key) + 1] & ~blank[2 : len(key) + 2]
    where = np.flatnonzero(sound)
    starts = offsets + 2 * np.arange(n + 1)
    return key[where], np.searchsorted(where, starts)


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    h = tk.mix(keys.astype(np.uint64) + np.uint64(0x51ED2701))
    return [((h >> np.uint64(32 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilters:
    """languages in order of frequency; table: (SLOTS, words of 64 languages); false: rate by language."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, 1), np.uint64))
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def shares(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language in the n-grams of each text; number of n-grams."""
        keys, first = _grams(column)
        out = np.zeros((len(column), len(self.languages)))
        n = np.diff(first)
        if not len(keys):
            return out, n
        places = _slots(keys)
        for word in range(self.table.shape[1]):
            bits = self.table[places[0], word]
            for p in places[1:]:
                bits = bits & self.table[p, word]
            for i in range(64 * word, min(len(self.languages), 64 * word + 64)):
                hits = tk.per_text((bits >> np.uint64(i - 64 * word)) & np.uint64(1) != 0, first)
                out[:, i] = hits / np.maximum(n, 1)
        return np.clip((out - self.false) / (1 - self.false), 0, 1), n

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        shares, _ = self.shares(column)
        best = np.argmax(shares, axis=1)
        score = shares[np.arange(n), best]
        data, offsets = tk.text_buffers(column)
        ascii_letter = (_FOLD[data] != 0x20) & (data < 128)
        plain = tk.per_text(ascii_letter, offsets) > 0
        lang = [self.languages[b] for b in best]
        for i in np.flatnonzero(~plain):
            if not any(map(str.isalpha, column[int(i)].as_py() or "")):
                lang[i], score[i] = UNKNOWN, 0.0
        return lang, score


def fit_filters(texts: list[str], langs: list[str], totals: dict[str, int] | None = None, min_share: float = 4e-6) -> LanguageFilters:
    """Filters of the n-grams seen twice or more, and by at least min_share, in a language's texts.

    totals: rows of each language in all data, for the order of languages; else the texts are counted.
    """
    if not texts:
        return LanguageFilters()
    totals = totals or {x: langs.count(x) for x in set(langs)}
    names = sorted(set(langs), key=lambda x: (-totals.get(x, 0), x))
    table = np.zeros((SLOTS, (len(names) + 63) // 64), dtype=np.uint64)
    false = np.zeros(len(names))
    for i, name in enumerate(names):
        keys, _ = _grams(pa.array([t for t, x in zip(texts, langs) if x == name], pa.large_string()))
        found, times = np.unique(keys, return_counts=True)
        found = found[times >= max(2, min_share * len(keys))]
        bit = np.uint64(1 << (i % 64))
        for p in _slots(found):
            np.bitwise_or.at(table[:, i // 64], p, bit)
        false[i] = np.mean(table[:, i // 64] & bit != 0) ** HASHES
    return LanguageFilters(names, table, false)


def remainder():
    """crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, per_language: int = 400, max_chars: int = 30_000, max_languages: int = 256) -> LanguageFilters:
    """Learns from about `per_language` different texts (of at most max_chars) of each language that aren't held out.

    The sample is drawn by a hash of doc_id and text at a rate per language; rows of one text count once. Only the
    `max_languages` most frequent values of lang are learned, so what reaches the driver (1.5 * per_language *
    max_languages texts at most) and the broadcast filters (8 MB for every 64 languages) are bounded however
    large docs is.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder() != 2) & (F.length("text") <= max_chars)).select(F.col("doc_id").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not totals:
        return LanguageFilters()
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")), F.lit(1 << 30))
    rates = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, per_language / n))))])
    chosen = known.where(spot < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0))).select("lang", "text").distinct()
    rows = chosen.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(per_language * max_languages * 3 // 2).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return fit_filters([r["text"] for r in rows], [r["lang"] for r in rows], totals)


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words for every 64 languages

    def work(batches):
        own = held.value
        for batch in batches:
            for part in tk.slices(batch, "text"):
                lang, score = own.predict(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def keep_language(docs: DataFrame, filters: LanguageFilters, min_score: float = 0.5) -> DataFrame:
    """The rows of docs that a language is found for with at least min_score; columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    schema, at = docs.schema, docs.columns.index("text")

    def work(batches):
        own = held.value
        for batch in batches:
            for part in tk.slices(batch, "text"):
                lang, score = own.predict(part.column(at))
                yield part.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()) if not own.languages else pa.array((np.array(lang, dtype=object) != UNKNOWN) & (score >= min_score)))

    return docs.mapInArrow(work, schema)
