"""Substrings, quality, language and near-duplicates on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import graph, langid, neardup, quality, queries, substrings
from tessera.llm import textkernel as tk
from tests.conftest import SMALL
from tests.llm.common import crowded_bucket, empty_docs, near_components, odd_docs, odd_texts, repeated, words


def test_words_of_a_slice_equal_the_pattern():
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for part in tk.slices(batch, "text", 700):
        w = tk.Words(part.column(0))
        raw = w.data.tobytes()
        got += [[raw[a:b].decode() for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]
    one = tk.Words(pa.array(["b a", "xx a", None, "a"]).slice(1))
    assert one.hashes[1] == one.hashes[2] != one.hashes[0]


def test_substrings_against_brute_force(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    gone = repeated([words(r.text) for r in rows])
    want = sorted((r.doc_id is None, r.doc_id or 0, len(g), sum(g), " ".join(w for w, x in zip(words(r.text), g) if not x)) for r, g in zip(rows, gone))
    done = substrings.remove_repeats(docs)
    assert done.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in done.collect())
    assert got == want and sum(x[3] for x in got) > 1000
    again = substrings.rewrite(docs)
    assert again.columns == docs.columns and again.count() == len(rows)
    assert substrings.remove_repeats(empty_docs(spark)).count() == 0


def test_substrings_in_random_mixtures(spark):
    rng = random.Random(11)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([36, 40, 80, 200]))] for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.choice([10, 34, 35, 36, 60, 300])] if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randrange(60))]
        texts.append(parts)
    texts += [["x"] * 80, ["x", "y"] * 40, [str(i % 36) for i in range(90)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(df).collect()}
    want = [" ".join(w for w, x in zip(t, g) if not x) for t, g in zip(texts, repeated(texts))]
    assert [got[i] for i in range(len(texts))] == want


def test_passages_in_several_automata(monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 3)
    p = substrings.Passages()
    p.add(1, 1, b"b c".split())
    p.add(1, 3, b"b c d".split())
    p.add(2, 0, "é b c".encode().split())
    assert len(p._automata) == 2
    assert p.locate(1, 0, b"a b c x".split()) == [] and p.sources() == []
    assert substrings._joined(p.locate(1, 10, b"b c x b c d".split())) == [(10, 12), (13, 16)]
    assert substrings._joined(p.locate(3, 0, "é b c".encode().split())) == [(0, 3)]
    assert p.sources() == [(1, 1, 3), (1, 3, 6), (2, 0, 3)]


def test_only_matches_of_the_automata_remove(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"u{i} {passage} v{i}") for i in range(5)], "doc_id long, text string")
    done = lambda: [r.n_removed for r in substrings.remove_repeats(docs).collect()]
    assert done() == [60] * 5
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substrings)  # so that the workers see the change
    try:
        monkeypatch.setattr(substrings.Passages, "locate", lambda *_: [])
        assert done() == [0] * 5
    finally:
        cloudpickle.unregister_pickle_by_value(substrings)


@pytest.mark.parametrize("parts", [3, 20_000])
def test_hot_passages_in_shards_of_their_own(spark, monkeypatch, parts):
    monkeypatch.setattr(substrings, "SHARD_PARTS", parts)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    rng = random.Random(7)
    line = [f"line{i}" for i in range(50)]
    texts = [[f"a{rng.random()}" for _ in range(rng.randrange(50))] + line[rng.randrange(8) :] + [f"b{rng.random()}" for _ in range(rng.randrange(50))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(df).collect()}
    assert got == {i: " ".join(w for w, x in zip(t, g) if not x) for i, (t, g) in enumerate(zip(texts, repeated(texts)))}


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_sequences_on_which_linear_hashes_collide(spark):
    one, other = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    shared = [f"w{i}" for i in range(34)]
    rows = [(0, " ".join([*shared, "".join(one)])), (1, " ".join([*shared, "".join(other)])), (2, "".join(one)), (3, "".join(other)), (4, "".join(one) + "\n" + "".join(other)), (5, " ".join(one)), (6, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = [words(t) for _, t in rows]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: sum(g) for i, g in enumerate(repeated(split))} and got[0] == got[1] == 0
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(docs).collect()} == dict.fromkeys(range(7), 0)
    same = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(docs).collect()}
    want, sizes = near_components(list(range(7)), [t for _, t in rows])
    assert same == {i: (want[i], sizes[i]) for i in range(7)} and same[2][0] != same[3][0]


def brute_quality(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts_against_brute_force(spark):
    docs = odd_docs(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *brute_quality(r.text)) for r in docs.collect())
    assert all(not r.kept for r in quality.quality(docs).collect() if r.base_failed)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.quality(empty_docs(spark)).count() == 0 and quality.keep_quality(empty_docs(spark)).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=(2, quality.N_FEATURES)), rng.normal(size=(2, 2)))
    lengths = [3, 0, 5, 1, 4]
    features, first = rng.normal(size=(13, quality.N_FEATURES)), np.concatenate([[0], np.cumsum(lengths)])
    got = field.decode(features, first)
    for a, b in zip(first[:-1], first[1:]):
        scores, best = features[a:b] @ field.emission.T, None
        for code in range(2 ** (b - a)):
            path = [(code >> i) & 1 for i in range(b - a)]
            total = sum(scores[i, p] for i, p in enumerate(path)) + sum(field.transition[p, q] for p, q in zip(path, path[1:]))
            best = max(best or (total, path), (total, path))
        assert got[a:b].tolist() == (best[1] if best else [])


def test_quality_keeps_clean_and_drops_junk(spark):
    import duckdb

    rows = duckdb.connect().sql("SELECT text, quality FROM '/root/testdata/sf0.1/labels.parquet' JOIN '/root/testdata/sf0.1/documents.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    field = quality.fit_field([t for t, _ in rows[:800]], [q > 0 for _, q in rows[:800]])
    held = rows[800:2400]
    m = quality.measure(pa.array([t for t, _ in held]), field, 0.5)
    good = np.array([q > 0 for _, q in held])
    sound = ~m["base_failed"]
    assert m["kept"][good & sound].mean() > 0.99 and m["kept"][~good & sound].mean() < 0.05
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert quality.train(docs, labels.where("false")) is quality.DEFAULT_FIELD and quality.fit_field([], []) is quality.DEFAULT_FIELD


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.identify(docs, langid.train(docs, 150)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and len(words(true[r.doc_id][1])) >= 5]
    assert sum(r.lang_pred == true[r.doc_id][0] for r in held) / len(held) > 0.97


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "zzz yyy xxx www", "held" if zlib.crc32(str(i).encode()) % 4 == 2 else "seen", None, None) for i in range(60)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).languages == ["seen"]


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == docs.count() and all(r.held_out is not None for r in got)
    texts = odd_texts()
    for r in got:
        if r.doc_id is not None:
            letters = any(map(str.isalpha, texts[r.doc_id] or ""))
            assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    nothing = langid.train(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(empty_docs(spark), langid.train(empty_docs(spark))).count() == 0
    kept = langid.keep_language(docs, langid.train(docs))
    assert kept.columns == docs.columns and langid.keep_language(docs, nothing).count() == 0


def test_many_languages_need_more_words():
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 26)}q zz{i:03d} " * 20 for i in range(70)]
    filters = langid.fit_filters(texts, [f"l{i:02d}" for i in range(70)])
    assert filters.table.shape[1] == 2
    assert filters.predict(pa.array(texts))[0] == [f"l{i:02d}" for i in range(70)]


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.where("doc_id is not null").collect()
    want, sizes = near_components([r.doc_id for r in rows], [r.text for r in rows])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(zip([r.doc_id for r in rows], sizes, want))
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want) | {None}


def test_one_row_of_a_group_is_kept(spark):
    def text(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    near = text("near").replace("near40", "changed")
    rows = [
        (1, text("twice"), "a"), (1, text("twice"), "a"), (2, text("clean"), "a"), (None, text("clean"), "a"),
        (None, text("nobody"), "a"), (None, text("nobody"), "a"), (None, text("nobody"), "b"), (3, text("near"), "a"), (None, near, "a"),
        (4, text("own"), "a"), (4, text("other"), "a"), (6, text("other"), "a"), (5, "", "a"), (5, None, "a"), (5, text("worded"), "a"), (None, None, "a"), (None, "", "a"),
    ]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        kept = neardup.keep_one(docs)
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        worded = {k: n for k, n in got.items() if k[1]}
        assert worded == {k: 1 for k in [(1, text("twice")), (2, text("clean")), (None, text("nobody")), (3, text("near")), (4, text("own")), (4, text("other")), (5, text("worded"))]}
        assert sum(n for k, n in got.items() if k[0] == 5 and not k[1]) == 1 and got[None, None] == got[None, ""] == 1
        # what is left has no copy, so no text loses its words to the next stage
        assert {(r.doc_id, r.text) for r in substrings.rewrite(kept).collect() if r.text} == set(worded)


def test_a_shared_footer_costs_few_comparisons(spark):
    footer = [f"foot{i}" for i in range(40)]
    texts = [(i, " ".join([f"t{i}x{j}" for j in range(170)] + footer)) for i in range(3000)]
    rows = neardup._numbered(spark.createDataFrame(texts, "doc long, text string"), "node")
    sketches = neardup.sketch(rows)
    none = spark.createDataFrame([], "node long, component long")
    groups = neardup.mixed_groups(sketches, none).selectExpr("n_out").collect()
    compared = neardup.mixed_groups(sketches, none).selectExpr("sum(case when out then n end)").first()[0] or 0
    assert compared < 30 * len(texts), (compared, len(groups))  # a comparison is 64 bytes of bit counts
    assert neardup._leader_pairs(sketches, 75).count() == 0 and neardup._forests(sketches, neardup.mixed_groups(sketches, none), 75).count() == 0


@pytest.mark.parametrize(("block", "held", "refine"), [(256, 1 << 24, 4096), (7, 1 << 24, 2), (256, 9000, 10)])
def test_near_duplicates_in_families(spark, monkeypatch, block, held, refine):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "GRID", block)
    monkeypatch.setattr(neardup, "REFINE", refine)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", held)
    rng = random.Random(3)
    texts = []
    for f in range(6):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                own[rng.randrange(len(own))] = f"e{rng.random()}"
            texts.append(" ".join(own))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == dict(zip(ids, near_components(ids, texts)[0]))


@pytest.mark.parametrize(("refine", "block"), [(4096, 512), (2, 512), (2, 3)])
def test_one_shared_bucket_is_enough_in_a_bucket_of_any_size(spark, monkeypatch, refine, block):
    monkeypatch.setattr(neardup, "REFINE", refine)
    monkeypatch.setattr(neardup, "GRID", block)
    texts = crowded_bucket()
    mins = neardup.minima(*neardup.shingle_sets(pa.array(texts)))
    bands = neardup.band_hashes(mins)
    assert np.count_nonzero(bands[-1] == bands[-2]) == 1 and np.count_nonzero((bands == bands[-1]).any(axis=1)) == len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == dict(zip(range(len(texts)), near_components(range(len(texts)), texts)[0])) and got[13] == 12


def test_signature_estimate():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    first = np.array([0, len(a), len(a) + len(b)])
    packed = neardup.signatures(neardup.minima(np.concatenate([a, b]), first))
    assert packed.shape[1] == neardup.K * neardup.BITS // 8
    assert abs(neardup.similarity(packed[:1], packed[1:])[0, 0] - 2000 / 3000) < 0.16


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_digest(spark):
    r = queries.op1_substrings(spark, SMALL).where("n_removed = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
