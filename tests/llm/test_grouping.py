"""The packing plan on histograms, and whole documents against the library's ids."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import grouping, queries

WORDS = P.path("word_bpe_49k.json")


def check(counts, made):
    """Every piece placed once, sequences gapless and not overfull."""
    ranks, held = {}, {}
    for length, first, n, sequence, offset, per in made.runs:
        assert ranks.get(length, 0) == first and n > 0
        ranks[length] = first + n
        for i in range(n):
            held.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert [ranks.get(n, 0) for n in range(len(counts))] == list(counts)
    assert set(held) == set(range(made.sequences))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= len(counts) - 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 80), st.data())
def test_any_histogram(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=80))
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    check(counts, grouping.plan(counts, data.draw(st.integers(1, 12)), data.draw(st.integers(0, capacity))))


@pytest.mark.parametrize("low,high,most", [(1, 2048, 1.012), (1, 600, 1.002), (300, 1200, 1.016), (1025, 2048, None)])
def test_few_sequences(low, high, most):
    rng = np.random.default_rng(low)
    counts = np.bincount(rng.integers(low, high, 20_000), minlength=2049).astype(np.int64)
    made = grouping.plan(counts)
    check(counts, made)
    least = -(-int((np.arange(2049) * counts).sum()) // 2048)
    assert made.sequences <= (20_000 if most is None else most * least)


def test_exact_configurations():
    """Lengths that fill sequences only in one way: 1000 + 600 + 448."""
    counts = np.zeros(2049, np.int64)
    counts[[1000, 600, 448]] = 5000
    assert grouping.plan(counts, small=256).sequences == 5000


def test_plan_does_not_grow_with_counts():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049).astype(np.int64)
    few, many = grouping.plan(counts, 32), grouping.plan(counts * 10**6, 32)
    assert len(many.runs) < 1.5 * len(few.runs) + 500 and many.sequences < 1.05e6 * few.sequences


def test_rounded_groups():
    counts = np.zeros(101, np.int64)
    counts[[50, 60, 70, 80]] = [3, 1, 4, 4]
    assert grouping.grouped_sizes(counts, 40, 2) == [(80, [[70, 2], [80, 4]]), (70, [[50, 3], [60, 1], [70, 2]])]
    assert grouping.grouped_sizes(counts, 55, 9) == [(80, [[80, 4]]), (70, [[70, 4]]), (60, [[60, 1]])]


@pytest.mark.parametrize("most_counts", [0, 10_000])
def test_documents(spark, docs_of, most_counts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    rows = [(i, f"word number {i} " * (i * 13 % 300)) for i in range(60)]
    rows += [(100, None), (100, None), (None, "x"), (7, ""), (7, "again"), (8, "long " * 9000), (9, "exact " * 2047), (10, "over " * 2048), (11, "漢字 é <|endoftext|>")]
    got = grouping.pack_best_fit(docs_of(rows).repartition(5), WORDS, most_counts=most_counts).collect()
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4").tobytes()
            want.append((str(d), piece, start, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.05 * -(-sum(w[3] for w in want) // 2048) + 1


def test_no_documents(spark, docs_of):
    assert grouping.pack_best_fit(docs_of([]), WORDS).count() == 0


def test_query(spark):
    got = queries.op12_grouping(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.select("doc_id").distinct().count() == 200
