"""Byte-level BPE of a tokenizers file through rank merges.

A file whose merges stand in the order of the ids they make merges the same pairs in the same order
as rank merges do, so the faster merge routine gives the library's ids; load_ranks refuses other files.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: The public pattern of byte-level BPE that splits a text into pre-tokens (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of so many characters in a row is cut out before the pattern runs, whose stack ends at about a million.
LONG_BLANK = 100_000
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_of_char() -> dict[str, int]:
    """The printable character that byte-level files write for each byte, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by token bytes, and ids of special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, table = spec["model"], byte_of_char()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) != len(made) or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is not a plain byte-level BPE with merges in id order")
    return ranks, special


@lru_cache(maxsize=2)
def encoding(path: str):
    """A tiktoken Encoding with the ids of the tokenizers file."""
    import tiktoken

    ranks, special = load_ranks(path)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(enc, text: str) -> list[int]:
    """Ids as the tokenizers library gives them by default: special strings in a text are special tokens."""
    if len(text) >= LONG_BLANK and (runs := [m.span() for m in _BLANK.finditer(text) if m.end() - m.start() >= LONG_BLANK]):
        return _around(enc, text, runs)
    if any(s in text for s in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def _around(enc, text: str, runs: list[tuple[int, int]]) -> list[int]:
    """Ids of a text with long white space at runs. By the pattern a run is one pre-token without its last
    character, which is left to what follows; at the end of a text or before a special string it is one as a whole."""
    ids, at = [], 0
    for start, end in runs:
        if end < len(text) and not any(text.startswith(s, end) for s in enc.special_tokens_set):
            end -= 1
        ids += encode(enc, text[at:start])
        ids += enc._core_bpe.encode_single_piece(text[start:end].encode())
        at = end
    return ids + encode(enc, text[at:])
