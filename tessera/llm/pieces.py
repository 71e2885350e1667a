"""SentencePiece encoding and decoding over a merge-type prefix table.

For every prefix of a string there is exactly one last token that its encoding can end with. The table
is filled from left to right: an automaton over the vocabulary yields the pieces that end at a place, and
the one that agrees with the last token of the prefix before it (the two, side by side, encode as
themselves) is stored. Ids are then read off backwards.

No piece has a space mark behind another character, so merges never cross from a word to a following
space; the table is built for one such word at a time and kept for repeated words in a bounded memo.

Defined results: null and empty text encode to the end id alone and decode to the empty text; equal rows
get equal results; an empty table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.schema import extended

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMO_WORDS, MEMO_PAIRS, MEMO_LENGTH = 600_000, 600_000, 48
JOINT = "\uffff"


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto.FromString(sp.serialized_model_proto())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only merge-type models with plain normalisation are handled")
        self.prefix = norm.add_dummy_prefix
        self.end_id = sp.eos_id()
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.unknown = sp.unk_id()
        if any(p.type == 4 for p in spec.pieces) or (spec.trainer_spec.byte_fallback and len(self.bytes_id) != 256):
            raise ValueError(f"{path}: user-defined pieces aren't handled")
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.units = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+" if self.by_word else "(?s:.+)").findall
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        if JOINT in self.id_of:
            raise ValueError(f"{path}: U+FFFF must not be a piece")
        self.shown = [str(i) for i in range(len(spec.pieces))]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string by the plain merge rule: best score first, leftmost on a tie."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: int, right: int) -> bool:
        a, b = self.piece_of[left], self.piece_of[right]
        return a + b not in self.id_of and self.merge(a + b) == [a, b]

    def encode_string(self, text: str) -> list[int]:
        """Ids of a string, spaces already marked. A character outside the vocabulary gets the id
        -1 - its code point; nothing merges with it, so strings joined by one encode apart."""
        n = len(text)
        last, size, pairs = [-1] * (n + 1), [1] * (n + 1), self.pairs
        if len(pairs) >= MEMO_PAIRS:
            pairs.clear()
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0:
                key = before << 24 | token
                if key in pairs:
                    if not pairs[key]:
                        continue
                else:
                    ok = pairs[key] = self.agree(before, token)
                    if not ok:
                        continue
            last[end], size[end] = token, length
        ids: list[int] = []
        while n:
            token = last[n]
            ids.append(token if token >= 0 else -1 - ord(text[n - 1]))
            n -= size[n]
        ids.reverse()
        return ids

    def _plain(self, ids: list[int]) -> bytes:
        """Ids as int32 bytes, characters outside the vocabulary spelt out."""
        if ids and min(ids) < 0:
            own = []
            for i in ids:
                if i >= 0:
                    own.append(i)
                elif self.bytes_id:
                    own += [self.bytes_id[b] for b in chr(-1 - i).encode()]
                else:
                    own.append(self.unknown)
            ids = own
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes, without an end id."""
        words = self.words
        if len(words) > MEMO_WORDS:
            words.clear()
        split = []
        for text in texts:
            units = self.units(text)
            if units and self.prefix:
                units[0] = SPACE + units[0]
            split.append(units)
        new = {u for units in split for u in units if u not in words}
        short = [u for u in new if len(u) <= MEMO_LENGTH and JOINT not in u]
        ids = self.encode_string(JOINT.join(short).replace(" ", SPACE)) if short else []
        at = 0
        for unit in short:
            try:
                to = ids.index(-1 - ord(JOINT), at)
            except ValueError:
                to = len(ids)
            words[unit] = self._plain(ids[at:to])
            at = to + 1
        once = {u: self._plain(self.encode_string(u.replace(" ", SPACE))) for u in new.difference(short)}
        if once:
            return [b"".join([words[u] if u in words else once[u] for u in units]) for units in split]
        return [b"".join(map(words.__getitem__, units)) for units in split]

    def ids(self, text: str) -> list[int]:
        return [*np.frombuffer(self.encode([text])[0], np.int32).tolist(), self.end_id]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs and `ids`, the ids of `text` with the end id; other columns stay."""
    if "ids" in docs.columns:
        raise ValueError("docs already has a column ids")
    schema = extended(docs.schema, ids="array<int>")
    at = docs.columns.index("text")

    def work(batches):
        m = model(path)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = pa.array([np.append(np.frombuffer(x, np.int32), np.int32(m.end_id)) for x in m.encode(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return docs.mapInArrow(work, schema)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids as decimal text, digest of the text decoded from them."""

    def work(batches):
        m = model(path)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                counts, of_ids, of_text = [], [], []
                for x in m.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(x, np.int32).tolist()
                    ids.append(m.end_id)
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(m.shown.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
