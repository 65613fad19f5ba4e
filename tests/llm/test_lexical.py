"""Ranked search against plain scoring of every document, and its SQL twin."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import lexical, queries

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, limit=10):
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for i, text in items:
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:limit])]
    return out


def results(df):
    return sorted(map(repr, map(tuple, df.collect())))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x250) | st.sampled_from("漢　 K "), max_size=40))
def test_terms(text):
    assert [t.decode() for t in lexical.terms_of(text.encode())] == cut(text)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "the", "THE"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = [(int(rng.integers(0, 400)), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=weights / weights.sum()))) for _ in range(500)]
    docs += [(900, None), (901, ""), (902, " .,; "), (903, "w5 " * 30_000), (None, "w1 w2 w3"), (None, "w40")] + [(910 + k, "same words w7 w8") for k in range(30)] + [(910, "same words w7 w8")]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 12))))) for i in range(25)] + [(50, None), (51, ""), (52, "absent"), (53, "same WORDS w7 same"), (54, "w1 " * 500), (55, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block_postings,block_items", [(50, 7), (2_000_000, 2000)])
def test_search(spark, docs_of, corpus, block_postings, block_items):
    docs, items = corpus
    asked = spark.createDataFrame([(i, t, 0, "own") for i, t in items], "item_id long, text string, rank int, term string")
    got = lexical.search(docs_of(docs).repartition(3), asked, block_postings=block_postings, block_items=block_items)
    assert results(got) == sorted(map(repr, plain(docs, items)))


def test_threshold_stops_early(corpus):
    """A rare term decides; the long list of a common one is not read to its end."""
    n = 20_000
    terms = np.concatenate([[0, 1]] * 20 + [[0]] * (n - 20)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum([2] * 20 + [1] * (n - 20))])
    impacts = np.where(terms == 1, 1000, 1).astype(np.int64)
    looked = []

    class Watched(lexical.Block):
        def lookup(self, docs, wanted):
            looked.extend(docs.tolist())
            return super().lookup(docs, wanted)

    best = lexical.Best(10)
    Watched(list(range(n)), edges, terms, impacts, 2).search(np.array([0, 1]), best, np.array([True, True]))
    assert [d for _, _, d in best.rows] == list(range(10)) and len(looked) < 100


def test_no_rows(spark, docs_of):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(docs_of([]), asked).count() == 0
    assert lexical.search(docs_of([(1, "word")]), asked.limit(0)).count() == 0
    assert lexical.search(docs_of([(1, "word")]), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_and_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()["op13_threshold"])
    names = [d[0] for d in found.description]
    got = queries.op13_threshold(spark, sf)
    assert sorted(names) == sorted(got.columns) and results(got.select(names)) == sorted(map(repr, found.fetchall()))
