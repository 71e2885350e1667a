"""Pieces, token counts and packing against the libraries; chats, archives and media against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bytebpe, chat, media, packing, pieces, queries, tokencount, warc
from tests.llm.common import empty_docs, odd_docs, odd_texts

BPE = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = [*"abcdefghijklmnopqrstuvwxyzABCXYZ", *"  \n\t0123.,'!-_#", "▁", "é", "ß", "日", "本", "\u0000", "😀", "​", "￿", "'s", " the", "ing", "<|endoftext|>", "</s>", "   "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_the_library():
    m = pieces.PieceModel(PIECES)
    texts = [t or "" for t in odd_texts()] + fuzz(4000, 1)
    got = [np.frombuffer(x, np.int32).tolist() for x in m.encode(texts)]
    assert got == m.library.encode(texts, num_threads=1)
    assert all(m.decode(m.ids(t)) == m.library.decode(m.library.encode(t, add_eos=True)) for t in texts[:300])


def test_pieces_with_small_memos(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 5)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 3)
    m = pieces.PieceModel(PIECES)
    for t in fuzz(200, 2):
        assert m.ids(t) == m.library.encode(t, add_eos=True)


def test_piece_digests(spark):
    docs = odd_docs(spark)
    sp = pieces.PieceModel(PIECES).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want.append((r.doc_id or -1, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digests(docs, PIECES).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.piece_digests(empty_docs(spark), PIECES).count() == 0
    one = pieces.encode_texts(docs.select("doc_id", "text"), PIECES).where("doc_id = 4").first()
    assert one.ids == sp.encode("two words", add_eos=True)


def test_ranks_equal_the_library():
    t = tokencount.load(BPE)
    enc = bytebpe.encoding(BPE)
    texts = [x or "" for x in odd_texts()] + fuzz(4000, 3)
    assert [bytebpe.encode(enc, x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        bytebpe.load_ranks(queries.tokenizer_path("word_bpe_49k.json"))


def test_whole_tokens_are_proven():
    t = tokencount.load(BPE)
    proven = tokencount.whole_tokens(t)
    assert len(proven) > 40_000 and " the" in proven
    sample = sorted(proven)[::97]
    assert all(len(e.ids) == 1 for e in t.encode_batch(sample, add_special_tokens=False))


def test_token_counts(spark, monkeypatch):
    t = tokencount.load(BPE)
    texts = [x or "" for x in odd_texts()] + fuzz(3000, 4)
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokencount, "MEMO", 10)
    counter = tokencount.Counter(BPE, tokencount.whole_tokens(t))
    assert counter.count(texts[:900]).tolist() + counter.count(texts[900:]).tolist() == want
    docs = odd_docs(spark)
    got = tokencount.token_counts(docs, BPE, 10).collect()
    for r in got:
        text = odd_texts()[r.doc_id] or "" if r.doc_id is not None else None
        if text is not None:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want[r.doc_id], want[r.doc_id] > 10)
    assert len(got) == docs.count() and tokencount.token_counts(empty_docs(spark), BPE).count() == 0


def held(pieces_, docs, t):
    """Checks that every id lies in one piece and sequences have no gap; returns lengths of sequences."""
    ids = Counter()
    for r in docs.collect():
        ids[r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces_:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for (doc, flat), n in ids.items():
        own = [r for r in by_doc[doc] if r.doc_tokens * 4 == len(flat) and flat[4 * r.start : 4 * (r.start + r.length)] == r.ids]
        assert sum(r.length for r in own) >= n * len(flat) // 4
    assert sum(r.length for r in pieces_) == sum(n * len(k[1]) // 4 for k, n in ids.items())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens
    return Counter(own[0].sequence_tokens for own in by_seq.values())


def test_long_white_space_is_encoded():
    enc, t, rng = bytebpe.encoding(BPE), tokencount.load(BPE), random.Random(2)
    mixed = "".join(rng.choice(" \n\t\u3000\u00a0\u2003\x85 ") for _ in range(1_100_000))
    texts = [f"word{' ' * 1_100_000}tail", f"a{mixed}!!{mixed[:200_000]}", f"{mixed}\n<|endoftext|>{' ' * 150_000}x", f"a \x1c{mixed} \u200b", "\n" * 1_100_000 + "b<|endoftext|>"]
    for text in texts:
        assert bytebpe.encode(enc, text) == t.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    t = tokencount.load(BPE)
    docs = odd_docs(spark)
    for shard_tokens in (2_000_000, 6000):
        done = packing.pack(docs, BPE, window=256, shard_tokens=shard_tokens).collect()
        lengths = held(done, docs, t)
        assert all(n == 256 or n & (n - 1) == 0 for n in lengths)
    again = packing.pack(docs.repartition(2), BPE, window=256, shard_tokens=6000).collect()
    assert sorted(map(str, again)) == sorted(map(str, done))
    assert packing.pack(empty_docs(spark), BPE).count() == 0


def test_packing_keeps_proportions():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 900) for _ in range(600)]
    queues = [list(range(0, 400)), list(range(400, 560)), list(range(560, 600)), []]
    tokens = [sum(lengths[k] for k in q) for q in queues]
    shares = [x / sum(tokens) for x in tokens]
    dealt = packing.deal(queues, lengths, shares, [0.0] * 4)
    got = Counter()
    source = {k: i for i, q in enumerate(queues) for k in q}
    last = max(p[3] for p in dealt) - 12
    for row, _, n, sequence, _ in dealt:
        got[source[row]] += n
        if sequence and sequence % 10 == 0 and sequence < last:
            total = sum(got.values())
            assert all(abs(got[i] - shares[i] * total) < 4096 for i in range(3))
    assert sum(p[2] for p in dealt) == sum(lengths)
    # a source that was given too little before is served first
    assert source[packing.deal(queues, lengths, shares, [-3000.0, 3000.0, 0.0, 0.0])[0][0]] == 1


@pytest.mark.parametrize("n_sources", [20, 60])
def test_every_window_holds_the_proportions(n_sources):
    rng = random.Random(1)
    queues, lengths = [], []
    for _ in range(n_sources):
        n = rng.randrange(20, 400)
        queues.append(list(range(len(lengths), len(lengths) + n)))
        lengths += [rng.randrange(1, 900) for _ in range(n)]
    left = [sum(lengths[k] for k in q) for q in queues]
    shares = [x / sum(left) for x in left]
    source = {k: i for i, q in enumerate(queues) for k in q}
    windows = defaultdict(Counter)
    dealt = packing.deal(queues, lengths, shares, [0.0] * n_sources)
    for row, _, n, sequence, _ in dealt:
        windows[sequence][source[row]] += n
    assert sum(p[2] for p in dealt) == sum(lengths)
    for _, got in sorted(windows.items()):
        left = [n - got[i] for i, n in enumerate(left)]
        if min(left) <= 0 or sum(got.values()) < 2048:  # a queue is empty, or the rest
            break
        assert all(abs(got[i] - shares[i] * 2048) <= n_sources for i in range(n_sources))
    # without credit for those left, and with a source of no share, the rest of a window is still a few pieces a source
    done = packing.deal([[0], [1], [2]], [9000, 9000, 9000], [0.2, 0.2, 0.0], [-5000.0, 0.0, 0.0])
    assert sum(p[2] for p in done) == 27000 and len(done) < 100


def test_packing_targets(spark):
    rows = [(i, "word " * 300, f"s{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = packing.pack(docs, BPE, targets={"s0": 3.0, "s1": 1.0}).collect()
    early = sorted({r.sequence_id for r in done})[:4]
    got = Counter()
    for r in done:
        if r.sequence_id in early:
            got[r.source] += r.length
    assert 0.65 < got["s0"] / sum(got.values()) < 0.85


def test_targets_hold_in_every_window_and_shard(spark):
    """Sources of targets other than their share of the tokens: none is missing from a window while it has tokens."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(40, 400))), f"s{i % 8}") for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {"s0": 3.0, "s1": 2.0}
    total = sum([3.0, 2.0] + [1.0] * 6)
    done = packing.pack(docs, BPE, window=512, targets=targets, others=1.0, shard_tokens=40_000).collect()
    by = defaultdict(lambda: defaultdict(list))
    for r in done:
        by[r.sequence_id // packing.SEQUENCES][r.sequence_id].append(r)
    assert len(by) > 3
    for shard in by.values():
        left = Counter()
        for rows_ in shard.values():
            for r in rows_:
                left[r.source] += r.length
        at = []
        for sequence in sorted(shard):
            got = Counter()
            for r in shard[sequence]:
                got[r.source] += r.length
            if min(left[f"s{i}"] for i in range(8)) > 1500:
                at.append(max(abs(got[s] / 512 - targets.get(s, 1.0) / total) for s in (f"s{i}" for i in range(8))))
            left.subtract(got)
        # the first window of a shard also settles what the shards before it left open
        assert at and max(at[1:], default=0) * 512 <= 8 and at[0] < 0.16, at  # a token a source


def test_many_equal_rows_go_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 20)
    t = tokencount.load(BPE)
    docs = spark.createDataFrame([(1, "word " * 50, "s")] * 200 + [(2, "other words", None)], "doc_id long, text string, source string").repartition(3)
    done = packing.pack(docs, BPE, window=256, shard_tokens=2000).collect()
    held(done, docs, t)
    assert len({r.sequence_id // packing.SEQUENCES for r in done if r.doc_id == 1}) >= 3


TURNS = "conv_id long, turn long, role string, text string, anchor int, n int"


def test_chat(spark, monkeypatch):
    rows = [(1, 1, "assistant", "fine", 0, 0), (1, 0, "user", "how\nare ### you </turn> \\", 0, 0), (2, 0, None, None, 0, 0), (2, 0, "assistant", None, 0, 0), (None, 3, "odd: role\n###", "é</turn>\n### user:\n", 0, 0), (None, None, "assistant", "日本", 0, 0), (3, 5, "assistant", "a", 0, 0), (3, 5, "assistant", "a", 0, 0)]
    rows += [(9, i, ("user", "assistant")[i % 2], f"text {i} \\# <b>", 0, 0) for i in range(40)]
    monkeypatch.setattr(chat, "SLICE_BYTES", 30)
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(3))
    got = {r.conv_id: r for r in chats.collect()}
    assert len(got) == 5
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    digests = {r.conv_id: r for r in chat.chat_digests(chats).collect()}
    for conv, turns in by.items():
        want = [(role, text) for _, _, role, text in sorted(turns)]
        assert chat.read_chat(got[conv].formatted) == want
        loss = "".join(text for role, text in want if role == "assistant")
        d = digests[conv]
        assert (d.n_turns, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(want), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(got[conv].formatted))
    with pytest.raises(ValueError):
        chat.read_chat("### user:\nno end")
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


PAGES = "page_id long, url string, html string, _digest string, n int"


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx y", big, "", 0), (2, None, big, "", 0), (3, "http://c/é", big + "x", "", 0), (4, "u", "small", "", 0), (5, "u", "small", "", 0), (6, "u", None, "", 0), (None, "u", big, "", 0), (2, "again", big, "", 0), (7, "u", "WARC/1.1\r\n\r\n" * 200, "", 0)]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    records = warc.read_archives(archives).collect()
    assert len(records) == len(rows) and all(r.sound for r in records)
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.resolved(warc.read_archives(archives)).collect())
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = sorted(((p or -1), *(("revisit", 2) if h == big and p != 2 else ("response", None)), len((h or "").encode()), sha(h)) for p, _, h, *_ in rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    for a in archives.collect():
        assert len(list(warc.parse_records(gzip.decompress(a.data)))) == a.n_records
    text = gzip.decompress(archives.first().data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.resolved(warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES)))).count() == 0


def test_media(spark, monkeypatch):
    docs = odd_docs(spark)
    containers, pool = media.store(docs)
    got = sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.restore(containers, pool).collect())
    want = []
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        m = media.wav_header(len(p)) + p
        want.append((r.doc_id or -1, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p)))
    assert got == sorted(want)
    digests = [r.digest for r in pool.collect()]
    assert len(digests) == len(set(digests)) > 0
    assert media.restore(*media.store(empty_docs(spark))).count() == 0
    import io
    import wave

    with wave.open(io.BytesIO(media.wav_header(64) + bytes(64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 64)


def test_chunks_move_with_their_content():
    rng = random.Random(8)
    body = bytes(rng.randrange(97, 123) for _ in range(40_000))
    a, b = media.chunks(body), media.chunks(b"some other start " + body)
    assert b"".join(a) == body and all(media.LEAST <= len(c) <= media.MOST for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert media.chunks(b"") == [b""] and media.chunks(b"x" * 100) == [b"x" * 100]


def test_damage_is_noticed(spark):
    containers, pool = media.store(odd_docs(spark, False))
    bad = pool.selectExpr("digest", "(select max(body) from values (X'28b52ffd2001090000ff') as t(body)) as body")
    with pytest.raises(Exception, match="damaged|rror"):
        media.restore(containers, bad).collect()


def test_damage_in_a_stored_container_is_noticed(spark):
    """restore() has only stored files: it notices a changed one, and does without the texts."""
    import glob
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    import zstandard

    from tessera.llm import common

    rng = random.Random(9)
    docs = spark.createDataFrame([(1, "".join(rng.choice("abcdefgh ") for _ in range(3000)))], "doc_id long, text string")
    containers, pool = media.store(docs)
    before = media.restore(containers, pool).collect()
    media_path = next(p for p in reversed(common._made) if p.endswith("/media"))
    changed = 0
    for path in glob.glob(f"{media_path}/*.parquet"):
        t = pq.read_table(path)
        if not t.num_rows:
            continue
        bodies = t.column("bodies").to_pylist()
        plain = bytearray(zstandard.ZstdDecompressor().decompress(bodies[0][0], max_output_size=media.MOST))
        plain[0] ^= 1
        bodies[0][0] = zstandard.ZstdCompressor(1).compress(bytes(plain))
        t = t.set_column(t.schema.get_field_index("bodies"), t.schema.field("bodies"), pa.array(bodies, t.schema.field("bodies").type))
        pq.write_table(t, path)
        crc = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
        changed += 1
    assert changed == 1 and len(before) == 1
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="damaged"):
        media.restore(containers, pool).collect()
