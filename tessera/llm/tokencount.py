"""Token counts by the whole-token shortcut.

Before the data is touched, every string of the vocabulary is encoded alone; those that come back as
one token are the proven set. The pre-tokens of a text that are in the set count one each; only the
rest is merged, and each distinct one once as long as a bounded memo holds it.

Defined results: null and empty text have 0 bytes and 0 tokens; equal rows get equal counts; an empty
table gives an empty result. Texts are taken whole. The special string inside a text is one token, as
the tokenizer's defaults have it.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.llm.bytebpe import PATTERN, encoding

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MEMO = 400_000
#: Characters about whose class every Unicode version agrees; other texts are split by the library itself.
_NEW = regex.compile(r"[^\x00-ԯḀ-⁯₠-₿　-ヿ一-龥]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    added = set(tokenizer.get_added_tokens_decoder())
    ids = [i for i in range(tokenizer.get_vocab_size()) if i not in added]
    strings = [s for s in tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)]
    sound = [(i, s) for i, s in zip(ids, strings) if s and "�" not in s]
    encoded = tokenizer.encode_batch([s for _, s in sound], add_special_tokens=False)
    split = regex.compile(PATTERN)
    return frozenset(s for (i, s), e in zip(sound, encoded) if e.ids == [i] and split.findall(s) == [s])


class Counter:
    """Counts of texts, exact for the given tokenizer file."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = load(path)
        self.split = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = regex.compile("(?:%s)" % "|".join(map(regex.escape, self.special))).split if self.special else None
        self.merge = encoding(path)._core_bpe.encode_single_piece
        self.memo: dict[str, int] = dict.fromkeys(whole, 1)
        self.proven = whole

    def count(self, texts: list[str]) -> np.ndarray:
        pieces: list[list[str]] = []
        extra = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                parts = self.parts(text)
                extra[k] = len(parts) - 1
            else:
                parts = [text]
            own: list[str] = []
            for part in parts:
                if part.isascii() or not _NEW.search(part):
                    own += self.split(part)
                else:
                    own += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            pieces.append(own)
        memo = self.memo
        if len(memo) > MEMO + len(self.proven):
            memo = self.memo = dict.fromkeys(self.proven, 1)
        rest = {p for own in pieces for p in own if p not in memo}
        if rest:
            memo.update((p, len(self.merge(p.encode()))) for p in rest)
        return np.fromiter((sum(map(memo.__getitem__, own)) for own in pieces), dtype=np.int64, count=len(texts)) + extra


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(load(path)))  # at most the vocabulary

    def work(batches):
        counter = _counter(path, proven.value)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                _, offsets = tk.text_buffers(part.column(1))
                n = counter.count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
