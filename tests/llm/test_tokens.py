"""Encoding, packing, rANS files: exact against the libraries."""

import base64
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.llm import packing, piece_codec, rans, word_ids

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "naïve ΣΑΣ İstanbul ǅ", "a\x1cb\x85c d", "é ́a ﬁ ½²³ ١٢ 漢字。", "Don't... STOP!!'s 'S 'LL'RE A.b.c,  x 　 y Ⱥb ŉ ß ẞ ſ K", "<|endoftext|> <|startoftext|>", "x" * 5000, "\n\n  \t tab", "́a b́", "👩‍👩‍👧 emoji"]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_chunked_ids_equal_the_library(hf, text):
    encoder = word_ids.word_ids(WORDS)
    assert encoder.encode([text])[0] == np.array(hf(text), "<u4").tobytes()


def test_chunked_ids_of_odd_texts(hf):
    encoder = word_ids.WordIds(WORDS)
    encoder.known.limit = 3  # generations change all the time
    for _ in range(2):
        for t in ODD:
            assert encoder.encode([t, None]) == [np.array(hf(t), "<u4").tobytes(), b""]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_equal_tiktoken(tik, text):
    codec = piece_codec.piece_codec(RANKS, P.PATTERN)
    ids = codec.encode([text])[0]
    assert ids.tolist() == tik.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_every_piece_is_reachable_or_direct(tik):
    codec = piece_codec.PieceCodec(RANKS, P.PATTERN)
    codec.limit = 2
    assert [x.tolist() for x in codec.encode(ODD)] == [tik.encode_ordinary(t) for t in ODD]


def test_piece_documents(spark, docs_of, tik):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (99, None), (None, "x")]
    got = piece_codec.encode_documents(docs_of(rows), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in got) == sorted((d is None, d or 0, tik.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert piece_codec.encode_documents(docs_of([]), RANKS, P.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.booleans())
def test_packing_fills_windows(lengths, closing):
    tiers = (2048, 1024, 512, 256)
    windows, left = packing.pack(lengths, tiers, closing)
    seen = {i: [] for i in range(len(lengths))}
    for w in windows:
        at = 0
        for doc, start, n, offset in w.pieces:
            assert offset == at and n > 0
            at += n
            seen[doc].append((start, n))
        assert at == w.used <= w.size
    for doc, start, n in left:
        seen[doc].append((start, n))
    for doc, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    short = [w for w in windows if w.used < w.size]
    assert len(short) <= 1 and (closing or not short) and (not closing or not left)
    groups, _ = packing.step_groups(windows, 4096, 0)
    for g in set(groups):
        assert len({windows[i].size for i, x in enumerate(groups) if x == g}) == 1


def test_pack_documents(spark, docs_of, hf):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "word " * 9000), (52, "same text"), (53, "same text"), (None, "no key")]
    got = packing.pack_documents(docs_of(rows), WORDS, buffer_tokens=3000).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        ids = [*hf(t or ""), 1]
        parts = sorted(by[d], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in parts) == np.array(ids, "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in parts)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs_of([]), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=400), st.integers(1, 64), st.integers(1, 9))
def test_rans_round_trip_and_parts(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1))
    assert int(table.freq.sum()) == 1 << rans.SCALE
    blob = rans.encode_block(ids, table, lanes, every)
    assert (rans.decode_block(blob, table) == ids).all()
    marks = rans.HEADER.unpack_from(blob)[6]
    parts = [rans.decode_block(blob, table, k) for k in range(marks + 1)]
    assert (np.concatenate(parts) == ids).all() if len(ids) else True


def test_rans_damage_is_seen():
    ids = np.arange(5000, dtype=np.uint32) % 97
    table = rans.Table.of_counts(np.bincount(ids))
    blob = bytearray(rans.encode_block(ids, table))
    blob[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(blob), table)
    with pytest.raises(ValueError):
        rans.decode_block(bytes(blob), rans.Table.of_counts(np.bincount(ids + 1)))


def test_rans_files(spark, docs_of, hf, tmp_path):
    rows = [(i * 7 % 11, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (101, "word " * 3000), (None, "first")]
    rans.write_ids(docs_of(rows), str(tmp_path / "f"), WORDS, block_tokens=50)
    got = rans.read_ids(spark, str(tmp_path / "f")).select("*", F.crc32("ids").alias("crc")).orderBy("start").collect()
    at, order = 0, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    for r, (_, t) in zip(got, order, strict=True):
        ids = np.array([*hf(t or ""), 2], "<u4")
        assert r.start == at and r.n_tokens == len(ids) and r.crc == zlib.crc32(ids.tobytes()) and bytes(r.ids) == ids.tobytes()
        at += len(ids)
    rans.write_ids(docs_of([]), str(tmp_path / "e"), WORDS)
    assert rans.read_ids(spark, str(tmp_path / "e")).count() == 0


def test_memos_are_bounded_by_bytes(hf, tik):
    """Long chunks are not kept, and short ones only up to the bound, however many a text has."""
    rng = np.random.default_rng(0)
    encoder = word_ids.WordIds(WORDS)
    for _ in range(50):
        encoder.encode([" ".join("".join(map(chr, rng.integers(97, 123, 5000))) + str(i) for i in range(8))])
    assert encoder.known.held == 0
    encoder.known.limit = 2_000_000
    text = " ".join(map(str, range(150_000)))
    assert encoder.encode([text])[0] == np.array(hf(text), "<u4").tobytes()
    assert encoder.known.held < 20_000_000 and len(encoder.known) + len(encoder.known.before) <= 100_000
    codec = piece_codec.PieceCodec(RANKS, P.PATTERN)
    for _ in range(20):
        han = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 2000)))
        assert codec.encode([han])[0].tolist() == tik.encode_ordinary(han)
    assert codec.held == 0 and not codec.known
    codec.limit = 100_000
    for at in range(0, 30_000, 1000):
        t = " ".join(f"w{i}x" for i in range(at, at + 1000))
        assert codec.encode([t])[0].tolist() == tik.encode_ordinary(t)
    assert codec.held < 2_000_000 and len(codec.before) < 10_000


def test_rans_one_key_is_many_tasks(spark, docs_of, tmp_path):
    rows = [(7, f"text {i}") for i in range(500)] + [(7, "same")] * 500 + [(8, "last")]
    rans.write_ids(docs_of(rows), str(tmp_path / "k"), WORDS)
    sizes = [len(r) for r in spark.read.parquet(str(tmp_path / "k" / "blocks")).rdd.glom().collect()]
    got = rans.read_ids(spark, str(tmp_path / "k")).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert len(got) == 1001 and got[-1].doc_id == 8 and sum(n > 0 for n in sizes) >= 3
