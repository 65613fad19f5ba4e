import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.functions.text import index_tokens, query_phrases, row_text, tokens
from tarnfold.operators import search


def documents(spark, texts):
    rows = [(i, t, "files", f"/d/doc{i}.txt", f"doc{i}.txt", ".txt", len(t or ""), i * 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source_id string, path string, name string, extension string, size long, mtime_ns long")


def test_tokens(spark):
    cases = {"Hello foo_bar": ["hello", "foo", "bar"], "中文字 a1": ["中", "文", "字", "中文", "文字", "a1"], "Straße ﬁn": ["strasse", "fin"], "über": ["ber"], "": [], "字": ["字"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokens(F.col("t")).alias("a"), index_tokens(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.a == cases[r.t] and r.b == cases[r.t]


def test_query_phrases():
    assert query_phrases("foo_bar 中文字 foo x x 字") == [["foo", "bar"], ["中文"], ["文字"], ["foo"], ["x"], ["字"]]


def brute_bm25(docs, phrases):
    n, lens = len(docs), [len(d) for d in docs]
    mean = sum(lens) / n

    def tf(d, p):
        return sum(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1))

    out = {}
    for i, d in enumerate(docs):
        score, hit = 0.0, False
        for p in phrases:
            df = sum(tf(x, p) > 0 for x in docs)
            f = tf(d, p)
            hit |= f > 0
            idf = math.log((n - df + 0.5) / (df + 0.5))
            score -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
        if hit:
            out[i] = score
    return out


def test_bm25_with_phrases(spark):
    split = [["foo", "bar", "x"], ["foo", "baz", "bar"], ["a", "b"], ["foo", "bar", "foo", "bar"], ["b"], ["c"], ["d"]]
    df = documents(spark, [" ".join(d) for d in split])
    got = {r.doc_id: r.score for r in search.keyword_scores(df, "foo_bar b").collect()}
    want = brute_bm25(split, [["foo", "bar"], ["b"]])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    first = [r.doc_id for r in search.keyword_search(df, "foo_bar b").collect()]
    assert first == sorted(want, key=lambda k: (round(want[k], 9), k))


def test_keyword_null_and_empty(spark):
    assert search.keyword_search(documents(spark, [None, "", "word"]), "word").select("doc_id").collect()[0][0] == 2
    assert search.keyword_search(documents(spark, ["x"]).limit(0), "word").count() == 0


def test_postings_agree_with_scan(spark):
    df = documents(spark, ["a b a", "b c", "c c c a", "d", "e", "f"])
    index = search.postings(df, "doc_id")
    lengths = df.select("doc_id", F.size(index_tokens(F.col("text"))).alias("length"))
    wanted = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "query_id int, term string")
    batch = {(r.query_id, r.doc_id): r.score for r in search.batch_keyword(index, lengths, wanted, 10, "doc_id").collect()}
    for q, text in ((1, "a c"), (2, "b")):
        for r in search.keyword_scores(df, text).collect():
            assert abs(batch[q, r.doc_id] - r.score) < 1e-12


def test_filters(spark):
    df = documents(spark, ["a", "bb", "ccc", "dddd"])
    pick = lambda **k: [r.doc_id for r in search.Filters(**k).apply(df).orderBy("doc_id").collect()]
    assert pick(min_size=2, max_size=3) == [1, 2]
    assert pick(directory="/d") == [0, 1, 2, 3] and pick(directory="/d/doc1.txt") == [1] and pick(directory="/") == [0, 1, 2, 3]
    assert pick(category="document") == [0, 1, 2, 3] and pick(category="image") == []
    assert pick(extension=".TXT", extensions=(".md", ".txt")) == [0, 1, 2, 3]
    assert pick(modified_after="1970-01-01T00:00:00.000000+00:00", modified_before="1970-01-02") == [0, 1, 2, 3]
    for bad in ({"extension": "txt"}, {"category": "x"}, {"min_size": -1}, {"min_size": True}, {"min_size": 3, "max_size": 2}, {"modified_after": "2024-01-02", "modified_before": "2024-01-02"}, {"extensions": ("." + "a" * 30,)}):
        with pytest.raises(ValueError):
            search.Filters(**bad)


def test_requests():
    assert search.check_request("x", "files", 1000) == 100 and search.check_request("x", "files", 0) == 1
    for bad in (("", "files"), ("x" * 1001, "files"), ("x", "other")):
        with pytest.raises(ValueError):
            search.check_request(*bad, 10)


def test_filename_exact_first_and_ascii_case(spark):
    df = documents(spark, ["a", "b", "c"]).withColumn("name", F.element_at(F.array(F.lit("xdoc.TXT"), F.lit("Doc.txt"), F.lit("ÄDOC.txt")), (F.col("doc_id") + 1).cast("int"))).withColumn("path", F.concat(F.lit("/d/"), "name"))
    assert [r.doc_id for r in search.filename_search(df, "DOC.txt").collect()] == [1, 0, 2]
    assert [r.doc_id for r in search.filename_search(df, "ädoc").collect()] == []


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.distance) for r in search.nearest(df, [1.0, 0.0], 5).collect()]
    assert got == [(0, 0.0), (4, 0.0), (3, round(1 - 1 / math.sqrt(2), 6)), (1, 1.0), (2, 1.0)]
    batch = search.nearest_batch(df, np.array([[1.0, 0.0], [0.0, 0.0]]), 3).orderBy("query_no", "rank").collect()
    assert [(r.query_no, r.vec_id) for r in batch] == [(0, 0), (0, 4), (0, 3), (1, 0), (1, 1), (1, 2)]
    odd = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.check_vectors(odd, 2).collect()] == [2]


def test_fusion_and_folding(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, rank int")
    out = {r.doc_id: (r.score, r.matches) for r in search.fused({"keyword": a, "semantic": b}, "doc_id").collect()}
    assert out[2] == (1 / 62 + 1 / 61, ["keyword", "semantic"]) and out[1] == (1 / 61, ["keyword"])
    hits = spark.createDataFrame([(1, "x", True), (2, "x", True), (3, "x", False), (4, "y", True)], "doc_id long, digest string, ready boolean")
    folded = {r.doc_id: r.other_locations for r in search.fold(hits, F.col("digest"), "doc_id", [F.col("doc_id")], F.col("ready")).collect()}
    assert folded == {1: [2], 3: [], 4: []}


def test_hybrid_without_vector(spark):
    df = documents(spark, ["word", "other", "word word"])
    assert {r.doc_id for r in search.hybrid_search(df, df, "word", None).collect()} == {0, 2}


def test_row_text(spark):
    df = spark.createDataFrame([("a", None, 3), ("x" * 13_000, "y", 1)], "p string, q string, r int")
    text, cut = row_text(["p", "q", "r"])
    rows = df.select(text.alias("t"), cut.alias("c")).collect()
    assert rows[0].t == "p: a\nr: 3" and not rows[0].c
    assert len(rows[1].t) == 12_000 and rows[1].c


def test_exact_ranks_of_whole_lists(spark):
    """Fusion over lists far longer than a page: the same as ranking all rows."""
    rng = np.random.default_rng(3)
    n = 3000
    a, b = rng.integers(0, 400, n).astype(float), rng.permutation(n).astype(float)
    rows = spark.createDataFrame([(k, float(a[k]), float(b[k])) for k in range(n)], "doc_id long, a double, b double").repartition(5)
    lists = {"keyword": rows.where("doc_id % 3 != 0").select("doc_id", F.col("a").alias("value")), "semantic": rows.select("doc_id", F.col("b").alias("value"))}
    for limit in (1, 7, 20):
        got = [(r.doc_id, round(r.score, 9), r.matches) for r in search.fused_top(lists, limit, "doc_id").collect()]
        ranks = {"keyword": sorted((k for k in range(n) if k % 3), key=lambda k: (a[k], k)), "semantic": sorted(range(n), key=lambda k: (b[k], k))}
        score, names = {}, {}
        for name, order in ranks.items():
            for r, k in enumerate(order):
                score[k] = score.get(k, 0) + 1 / (search.RANK_BASE + r)
                names.setdefault(k, []).append(name)
        best = sorted(score, key=lambda k: (-round(score[k], 9), k))[:limit]
        assert got == [(k, round(score[k], 9), sorted(names[k])) for k in best]
    assert search.fused_top({"keyword": lists["keyword"].limit(0)}, 5, "doc_id").count() == 0


def test_index_agrees_with_the_scan(spark, tmp_path):
    from tarnfold.operators.index import KeywordIndex

    texts = ["the cat sat on the mat", "a cat_sat here", "cat cat cat", "", "THE MAT the mat the mat", "数据库 服务器 cat", None, "sat cat sat"]
    rows = spark.createDataFrame([(i, t, f"/d/{i}", f"{i}.txt", ".txt", "files", 10 * i, i) for i, t in enumerate(texts)], "doc_id long, text string, path string, name string, extension string, source_id string, size long, mtime_ns long")
    index = KeywordIndex.build(rows, str(tmp_path / "index"), buckets=4)
    assert index.rows == 8 and KeywordIndex.open(spark, index.path) == index and "text" not in index.documents.columns
    scanned = rows.fillna("", ["text"])
    for query in ("cat", "the mat", "cat_sat", "the_mat cat", "数据", "nothing", "the_mat_the"):
        want = {r.doc_id: round(r.score, 9) for r in search.keyword_scores(scanned, query).collect()}
        assert {r.doc_id: round(r.score, 9) for r in index.scores(query).collect()} == want
        for filters in (None, search.Filters(min_size=20, file_source=None)):
            for sort in search.SORTS if query == "the_mat cat" else ("relevance",):
                page = [r.doc_id for r in search.keyword_search(scanned, query, 3, filters, sort).collect()]
                assert [r.doc_id for r in index.search(query, 3, filters, sort).collect()] == page
    plan = index.terms(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert "EqualTo(term,cat)" in plan or "In(term, [cat])" in plan


def test_dear_rows_are_made_once(spark):
    """With ``shown``, statistics and scores come from one pass over the rows; the result is that of two."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = documents(spark, ["a b a", "b c", "c c c a", "d", None, ""])
    want = {r.doc_id: round(r.score, 9) for r in search.keyword_scores(df, "a c_c").collect()}
    hits = search.keyword_scores(df.mapInArrow(made, df.schema), "a c_c", shown=["doc_id"])
    assert {r.doc_id: round(r.score, 9) for r in hits.collect()} == want and hits.columns == ["doc_id", "score"]
    assert seen.value == df.count()
