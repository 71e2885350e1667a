"""Small frames of odd rows, and brute-force versions of the operators' definitions."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHING = ["key", "anchor", "content", "n", "shard", "ids_", "node", "bucket", "_held", "_content", "bands", "component", "label", "value", "_size"]


def words(text):
    return WORD.findall(text or "")


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(p) for p in itertools.product("bdglmnrst", "aeiou", "lnrs", "aeo")][:400]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long = make(120), make(50), make(9000)
    changed = base.split()
    changed[60] = "CHANGED"
    return [
        None, "", "   \n\t ", "one", "two words", base, base, base.upper(), " ".join(changed), "\n".join(base.split()), f"{make(40)} {passage} {make(30)}", f"{passage} {make(60)}",
        f"{make(10)}\n{passage}", f"{passage} {passage}", " ".join(["same"] * 100), " ".join(["same"] * 36), long, f"{long} tail", make(34), make(35), "日本語 のテキスト です", "é" * 300, "naïve café — “quoted” … 🎉", "<|endoftext|> <s> </s> <unk> ▁ ▁x",
        "a\x1cb\x85c d​e", "12345 67890", "!!! ??? ***", "x" * 5000, "\\### Assistant: </turn>", "line\nline\nline\nother\n\nline",
    ]


def odd_docs(spark, extra: bool = True):
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], (None, odd_texts()[5], "en", "s1", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def repeated(texts: list[list[str]], size: int = 35) -> list[list[bool]]:
    """Which words lie in a window that starts anywhere else."""
    seen = Counter(tuple(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[tuple(t[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_components(ids, texts, threshold=75):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = defaultdict(list)
    for i, doc in enumerate(ids):
        by_id[doc].append(i)
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] == ids[j] or (both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both)):
                parent[root(i)] = root(j)
    low = {}
    for i, doc in enumerate(ids):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return [low[root(i)] for i in range(len(ids))], [len(s) for s in sets]


def crowded_bucket():
    """Texts of which the last two are linked (168 of 224 shingles) but share one bucket only, with all the others."""
    first = [f"p450w{i}" for i in range(200)]
    second = first[:88] + [f"p450x{i}" for i in range(24)] + first[112:]
    core = [w for i in (23, 37, 72, 156) for w in first[i : i + 5]]  # the shingles whose hashes are the bucket's
    others = [core + [f"f{f}e{i}" for i in range(30)] for f in (0, 1, 2, 4, 6, 7, 9, 11, 12, 13, 15, 16)]
    return [" ".join(t) for t in (*others, first, second)]
