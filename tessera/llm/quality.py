"""Quality rules: a linear-chain conditional random field over lines.

Each line with a word is labelled content or boilerplate by Viterbi decoding; the share of words in
content lines decides whether the text stays, after fixed base rules.

Defined results: null text, empty text and text of white space have no words and fail the base rules
(kept false); equal rows get equal results; an empty table gives an empty result; other columns of
the input are not looked at. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 12
CONTENT, BOILERPLATE = 1, 0
PIECE = 16
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"!?@/\\=_{}[]~^")] = True


@dataclass(frozen=True)
class LineField:
    """A chain field of two labels: emission (2, features) and transition (2, 2) weights."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels; chain i holds the lines first[i] to first[i + 1]. All chains advance together."""
        scores = features @ self.emission.T
        n, lengths = len(scores), np.diff(first)
        if not n:
            return np.zeros(0, dtype=np.int8)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = first[:-1][order], lengths[order]
        back = np.zeros((n, 2), dtype=np.int8)
        live = int(np.searchsorted(-lengths, 0, side="left"))
        best = scores[starts[:live]].copy()
        final = np.zeros((len(order), 2))
        for step in range(1, int(lengths[0]) + 1):
            going = int(np.searchsorted(-lengths, -step, side="left"))
            final[going:live] = best[going:live]
            if not going:
                break
            at = starts[:going] + step
            options = best[:going, :, None] + self.transition[None]
            back[at] = np.argmax(options, axis=1)
            best, live = np.max(options, axis=1) + scores[at], going
        labels = np.zeros(n, dtype=np.int8)
        live = int(np.searchsorted(-lengths, 0, side="left"))
        state = np.argmax(final[:live], axis=1).astype(np.int8)
        for step in range(int(lengths[0]) - 1, -1, -1):
            going = int(np.searchsorted(-lengths, -step, side="left"))
            at = starts[:going] + step
            labels[at] = state[:going]
            state[:going] = back[at, state[:going]]
        return labels


#: Used where no labelled rows are at hand: marks, capitals and symbols speak for boilerplate.
DEFAULT_FIELD = LineField(
    emission=np.array([[-2.0, 8.0, 6.0, 4.0, 6.0, 1.0, 0, 0, 0, 0, 0, 0], [0.0] * N_FEATURES]),
    transition=np.array([[0.5, 0.0], [0.0, 0.5]]),
)


class Lines:
    """Lines with a word, their features, and the counts of the base rules, for a slice of texts."""

    def __init__(self, column: pa.Array):
        w = self.words = tk.Words(column)
        data, offsets, n = w.data, w.offsets, len(column)
        inner = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], inner + 1]))
        ends = np.sort(np.concatenate([offsets[1:], inner]))
        text = np.repeat(np.arange(n), np.searchsorted(inner, offsets[1:]) - np.searchsorted(inner, offsets[:-1]) + 1)
        w0, w1 = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
        full = w1 > w0
        starts, ends, text, w0, w1 = starts[full], ends[full], text[full], w0[full], w1[full]
        self.first = np.searchsorted(text, np.arange(n + 1))
        self.n_words = w1 - w0
        number, distinct = tk.codes(tk.spans(data, starts, ends))
        _, index = np.unique(text * max(1, len(distinct)) + number, return_index=True)
        self.duplicate = np.ones(len(starts), dtype=bool)
        self.duplicate[index] = False
        self._features = lambda: self._make(data, starts, ends)

    def _make(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        def share(table: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(table[data], out=sums[1:])
            return (sums[ends] - sums[starts]) / np.maximum(1, ends - starts)

        upper, lower = share(_UPPER), share(_LOWER)
        closing = np.isin(data[np.maximum(ends - 1, 0)], list(b".!?:;\"'"))
        n = self.n_words
        return np.column_stack([
            np.ones(len(starts)), share(_SYMBOL) * 4, upper / np.maximum(upper + lower, 0.02), share(_DIGIT) * 2, share(_MARKS) * 4,
            self.duplicate, closing, n <= 2, n >= 12, np.minimum((ends - starts) / np.maximum(n, 1), 20) / 10, share(_SYMBOL) > 0.04, share(_MARKS) > 0.04,
        ]).astype(np.float64)

    @property
    def features(self) -> np.ndarray:
        return self._features()


def measure(column: pa.Array, field: LineField, min_share: float, min_words: int = 20, max_repeat: int = 30, window: int = 8) -> dict[str, np.ndarray]:
    """Counts, verdict of the base rules and of the field for each text of a slice."""
    lines = Lines(column)
    w, n = lines.words, len(column)
    lead = (w.data & 0xC0) != 0x80
    sums = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(lead, out=sums[1:])
    chars = tk.per_text(sums[w.ends] - sums[w.starts], w.first)
    symbols = tk.per_text(_SYMBOL[w.data], w.offsets)
    n_words = w.counts
    repeat = np.zeros(n, dtype=np.int64)
    size = len(w.starts)
    if size >= window:
        whole = np.flatnonzero(w.whole(window))
        text = w.text_of()
        keys = tk.window_codes(w.codes, window)[whole] * n + text[whole]
        flags = np.zeros(size, dtype=bool)
        flags[whole] = tk.group_counts(keys) > 1
        repeat = tk.per_text(tk.covered(flags, window, size), w.first)
    labels = field.decode(lines.features, lines.first)
    in_content = tk.per_text(lines.n_words * (labels == CONTENT), lines.first)
    share = in_content / np.maximum(1, n_words)
    failed = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": tk.per_text(lines.duplicate, lines.first),
        "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & (share >= min_share), "content_share": share,
        "n_lines": np.diff(lines.first), "n_content_lines": tk.per_text(labels == CONTENT, lines.first),
    }


def fit_field(texts: list[str], good: list[bool], steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> LineField:
    """Fits the field by gradient ascent on its log-likelihood, with lines labelled as their text is.

    A clean text holds no boilerplate line; of a bad one only lines unlike those of clean texts should
    count, so labels are refined once: lines of bad texts that the first fit takes for content become content.
    Chains of more than PIECE lines are fitted in pieces, since each step of the fit takes time by the longest.
    """
    if not texts or all(good) or not any(good):
        return DEFAULT_FIELD
    lines = Lines(pa.array(texts, pa.large_string()))
    features = lines.features
    good_line = np.repeat(np.array(good, dtype=bool), np.diff(lines.first))
    first = np.unique(np.concatenate([lines.first, *(np.arange(a, b, PIECE) for a, b in zip(lines.first[:-1], lines.first[1:]) if b - a > PIECE)]))
    labels = np.where(good_line, CONTENT, BOILERPLATE)
    field = _ascend(features, first, labels, steps, rate, ridge)
    refined = np.where(good_line, CONTENT, field.decode(features, first))
    return _ascend(features, first, refined, steps, rate, ridge)


def _ascend(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int, rate: float, ridge: float) -> LineField:
    n, lengths = len(features), np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    width = int(lengths[0]) if len(lengths) else 0
    balance = np.where(labels == CONTENT, 0.5 / max(1, np.sum(labels == CONTENT)), 0.5 / max(1, np.sum(labels != CONTENT)))
    inner = np.ones(n, dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    pair = np.flatnonzero(inner)
    seen_e, seen_t = np.zeros((2, features.shape[1])), np.zeros((2, 2))
    for k in (0, 1):
        seen_e[k] = (balance * (labels == k)) @ features
    np.add.at(seen_t, (labels[pair - 1], labels[pair]), balance[pair])
    emission, transition = np.zeros_like(seen_e), np.zeros((2, 2))
    square_e, square_t = np.full_like(emission, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        scores = features @ emission.T
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for s in range(width):
            at = starts[: np.searchsorted(-lengths, -s, side="left")] + s
            ahead[at] = scores[at]
            if s:
                m = ahead[at - 1][:, :, None] + transition[None]
                ahead[at] += np.logaddexp(m[:, 0], m[:, 1])
        for s in range(width - 2, -1, -1):
            at = starts[: np.searchsorted(-lengths, -(s + 1), side="left")] + s
            m = transition[None] + (behind[at + 1] + scores[at + 1])[:, None, :]
            behind[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        both = ahead + behind
        both -= both.max(axis=1, keepdims=True)
        marginal = np.exp(both)
        marginal /= marginal.sum(axis=1, keepdims=True)
        gain_e = seen_e - np.stack([(balance * marginal[:, k]) @ features for k in (0, 1)]) - ridge * emission
        joint = ahead[pair - 1][:, :, None] + transition[None] + (behind[pair] + scores[pair])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        gain_t = seen_t - np.einsum("n,nij->ij", balance[pair], joint) - ridge * transition
        square_e += gain_e**2
        square_t += gain_t**2
        emission += rate * gain_e / np.sqrt(square_e)
        transition += rate * gain_t / np.sqrt(square_t)
    return LineField(emission, transition)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, max_chars: int = 40_000, max_lines: int = 400) -> LineField:
    """Fits the field on at most `sample_rows` different labelled texts of at most `max_chars` characters and
    `max_lines` lines each.

    The sample is drawn by a hash of doc_id and text, so every run draws the same texts and a doc_id of many rows
    brings no more than its share. The bounds keep the driver's share fixed however large the tables are.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    total = known.count()
    if not total:
        return DEFAULT_FIELD
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30))
    rate = int((1 << 30) * min(1.0, 1.2 * sample_rows / total))
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars) & (breaks < max_lines))
    rows = texts.where(spot < rate).join(known.where(spot < rate), "doc_id").select("doc_id", "text", "_quality").distinct()
    rows = rows.withColumn("_spot", F.xxhash64("doc_id", "text", F.lit("quality"))).orderBy("_spot", "doc_id", "text").limit(sample_rows).collect()
    return fit_field([r["text"] for r in rows], [r["_quality"] > 0 for r in rows])


def quality(docs: DataFrame, field: LineField = DEFAULT_FIELD, min_share: float = 0.5) -> DataFrame:
    """One row a text with the counts of SCHEMA. docs needs doc_id and text."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                found = measure(part.column(1), field, min_share)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c]) for c in names[1:])], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)


def keep_quality(docs: DataFrame, field: LineField = DEFAULT_FIELD, min_share: float = 0.5) -> DataFrame:
    """The rows of docs whose text is kept, all columns as they are."""
    schema, at = docs.schema, docs.columns.index("text")

    def work(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield part.filter(pa.array(measure(part.column(at), field, min_share)["kept"]))

    return docs.mapInArrow(work, schema)
