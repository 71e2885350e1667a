from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.conftest import SMALL  # noqa: E402
from tessera.llm import neardup, quality, queries, tokencount  # noqa: E402
from tests.llm.common import crowded_bucket, empty_docs, near_components, odd_docs, repeated, words  # noqa: E402
from tests.llm.test_texts import brute_quality  # noqa: E402


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SMALL)
        assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < done.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "substrings", "packing"]


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, SMALL).collect()))
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert all(n == k[1] for k, n in tokens.items())


def test_odd_rows_pass(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    assert docs.columns == odd_docs(spark).columns
    assert corpus_pipeline.pack(spark, docs, SMALL).count() > 0
    none = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def plain_rows(rows):
    """Rows (doc_id, text) by brute force: one of each near-duplicate group, then recurring passages out."""
    groups, sizes = near_components(list(range(len(rows))), [r[1] for r in rows])
    best = {}
    for i, (doc, _) in enumerate(rows):
        key = (groups[i],) if sizes[i] else ("id", doc) if doc is not None else ("row", i)
        if key not in best or (doc is None, doc or 0) < (rows[best[key]][0] is None, rows[best[key]][0] or 0):
            best[key] = i
    left = [rows[i] for i in best.values()]
    split = [words(t) for _, t in left]
    gone = repeated(split)
    return left, [(doc, " ".join(w for w, x in zip(own, out) if not x) if any(out) else t) for (doc, t), own, out in zip(left, split, gone)]


@pytest.mark.parametrize("odd", [True, False])
def test_last_stages_equal_brute_force(spark, odd):
    docs = odd_docs(spark) if odd else spark.read.parquet(f"{SMALL}/documents.parquet")
    if not odd:  # repeated rows and copies of null doc_id
        some = docs.where("doc_id % 10 = 0")
        docs = docs.unionByName(some).unionByName(some.selectExpr("cast(null as long) as doc_id", *some.columns[1:]))
    left, cut = plain_rows([(r.doc_id, r.text) for r in docs.collect()])
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter(left)
    rest = corpus_pipeline.cut_repeats(spark, one, SMALL)
    assert Counter((r.doc_id, r.text) for r in rest.collect()) == Counter(cut)
    t = tokencount.load(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for doc, text in cut:
        ids[doc].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    got = Counter()
    for r in corpus_pipeline.pack(spark, rest, SMALL).collect():
        crcs = {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id] if len(x) == r.doc_tokens}
        assert r.ids_crc32 in crcs
        got[r.doc_id] += r.length
    assert got == {doc: sum(map(len, own)) for doc, own in ids.items()}


def plain_verdict(text, field):
    """Whether a text stays, by the base rules and the best labels of its lines, line by line; features are the operator's."""
    lines = quality.Lines(pa.array([text], pa.large_string()))
    if brute_quality(text)[-1]:
        return False
    scores = lines.features @ field.emission.T
    best = [(scores[0, k], [k]) for k in (0, 1)]
    for row in scores[1:]:
        best = [max((best[p][0] + field.transition[p, k] + row[k], [*best[p][1], k]) for p in (0, 1)) for k in (0, 1)]
    inside = sum(int(n) for n, k in zip(lines.n_words, max(best)[1]) if k == quality.CONTENT)
    return 2 * inside >= len(words(text))


@pytest.mark.parametrize("odd", [True, False])
def test_first_stage_equals_line_by_line(spark, odd):
    docs = odd_docs(spark) if odd else spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    field = quality.train(docs, labels)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, docs, SMALL).collect())
    assert kept == Counter((r.doc_id, r.text) for r in docs.collect() if plain_verdict(r.text, field))


def test_first_stages_keep_clean_documents(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{at}/labels.parquet").where("quality > 0").collect()}
    clean = {r.doc_id for r in docs.collect() if r.doc_id in good and not brute_quality(r.text)[-1]}
    one = corpus_pipeline.keep_quality(spark, docs, at)
    two = corpus_pipeline.keep_language(spark, one, at)
    left = [{r.doc_id for r in x.select("doc_id").collect()} for x in (one, two)]
    assert len(clean) > 100 and len(clean & left[0]) > 0.98 * len(clean)
    # documents of a known language are prose, whatever the language
    known = {r.doc_id for r in one.where("lang is not null").collect()}
    assert len(known & left[1]) > 0.99 * len(known)


@pytest.mark.parametrize("refine", [4096, 2])
def test_near_duplicates_go_whatever_the_size_of_their_bucket(spark, monkeypatch, refine):
    monkeypatch.setattr(neardup, "REFINE", refine)
    texts = crowded_bucket()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in one.collect()) == list(range(len(texts) - 1))
