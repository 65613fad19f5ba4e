"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from tarnfold import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.oracle_sql():
        found = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def local_rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_pages_and_chunks_against_the_plain_functions(spark, duck):
    """What has no SQL: the extraction and chunking queries, file by file, without Spark."""
    import hashlib
    import json

    from tarnfold.operators.chunking import split_pieces
    from tarnfold.sources import files

    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    want = []
    for page_id, html in pages:
        out = files.extract_bytes(f"page{page_id}.html", html.encode(), files.WHOLE, files.WHOLE)
        want.append((f"page{page_id}.html", out["status"], out["truncated"], len(out["chunks"]), "\n".join(c["text"] for c in out["chunks"])))
    assert sorted(map(tuple, local_rows(spark, "page_text"))) == sorted(want)
    got = {}
    for r in local_rows(spark, "chunk_documents"):
        assert r.hash == hashlib.sha256(r.text.encode()).hexdigest()
        got.setdefault(r.path, []).append((r.ordinal, r.text, r.locator))
    texts = {r.path: r.text for r in registry.corpus(spark, SF).select("path", "text").collect()}
    for path, text in texts.items():
        out = files.extract_bytes("a.txt", text.encode(), files.WHOLE, files.WHOLE)
        pieces = [(c["text"], json.loads(c["locator"])) for c in out["chunks"]]
        whole = [(n, t, json.dumps(x, sort_keys=True)) for n, (t, x) in enumerate(split_pieces(pieces, files.WHOLE))]
        assert sorted(got.get(f"{path}.txt", [])) == whole


def test_best_chunks_against_plain_scoring(spark):
    """kw_bm25_chunk: BM25 of every chunk, the best of each document, from scratch."""
    import math
    import re

    from tarnfold.functions.text import FOLDED

    def tokens_of(text):
        for a, b in FOLDED.items():
            text = text.replace(a, b)
        return re.findall("[a-z0-9]+", text.lower())

    chunks = [(f"{r.path}#{r.ordinal}", r.path, tokens_of(r.text)) for r in local_rows(spark, "chunk_documents")]
    mean, best = sum(len(t) for _, _, t in chunks) / len(chunks), {}
    with_word = {w: sum(w in t for _, _, t in chunks) for w in registry._WORDS}
    for chunk, path, tokens in chunks:
        score = 0.0
        for w, n in with_word.items():
            if tf := tokens.count(w):
                odds = math.log((len(chunks) - n + 0.5) / (n + 0.5))
                score -= (odds if odds > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
        if score:
            best[path] = min(best.get(path, (1.0, "")), (round(score, 9), chunk))
    want = sorted(best.values())[:20]
    assert sorted((plain(r.score), r.chunk) for r in local_rows(spark, "kw_bm25_chunk")) == sorted((plain(round(s, 6)), c) for s, c in want)


def test_encodings_against_the_provider(spark):
    from tarnfold.operators.vectors import hashing_provider

    texts = {r.chunk_id: r.text for r in registry.turns(spark, SF).where("semantic").collect()}
    rows = local_rows(spark, "embed_encode")
    assert sorted(r.chunk_id for r in rows) == sorted(texts)
    for r in rows:
        assert list(r.embedding) == hashing_provider()([texts[r.chunk_id] or ""])[0].tolist()


def test_recall_does_not_shuffle_the_texts(spark, tmp_path):
    """recall_at_k: the few hits go to the documents."""
    import __spark_entry__

    plan = __spark_entry__.queries()["recall_at_k"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    documents = [x for x in plan.splitlines() if "text#" in x and "doc_id" in x]
    assert documents and "Repartition" not in plan and "Window" not in plan.split("Relation")[1]


def test_citations_do_not_shuffle_the_texts(spark):
    """kw_cited: a table of one file is dealt out as what is asked of it; the texts' sizes, not the texts."""
    import __spark_entry__

    plan = __spark_entry__.queries()["kw_cited"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [i for i, x in enumerate(plan) if "Repartition" in x]
    assert dealt and all("octet_length" in plan[i + 1] for i in dealt)
