"""The keyword index: changes against a rebuild, segments and manifests, pages from few bands."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import search
from tarnfold.operators.index import KeywordIndex

WORDS = [f"w{i}" for i in range(40)]
SCHEMA = "doc_id long, text string, size long, source_id string, mtime_ns long, name string"


def rows_of(seed, ids, rng_words=WORDS):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(rng_words) + 1)
    return {i: " ".join(rng.choice(rng_words, int(rng.integers(0, 40)), p=p / p.sum())) or None for i in ids}


def table(spark, texts):
    return spark.createDataFrame([(i, t, 10 * i, "files", i, f"{i}.txt") for i, t in texts.items()], SCHEMA)


def hits(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def same(spark, index, texts, queries=("w3 w17 w30", "w1_w0 w5")):
    rows = table(spark, texts).fillna("", ["text"])
    assert index.rows == len(texts) and sorted(r.doc_id for r in index.documents.select("doc_id").collect()) == sorted(texts)
    for q in queries:
        want = hits(search.keyword_scores(rows, q))
        assert hits(index.scores(q)) == want
        page = [r.doc_id for r in index.search(q, 7).collect()]
        assert page == [d for _, d in sorted((s, d) for d, s in want.items())[:7]]


def test_changes_equal_a_rebuild(spark, tmp_path):
    texts = rows_of(1, range(60))
    index = KeywordIndex.build(table(spark, texts), str(tmp_path / "i"), buckets=4)
    same(spark, index, texts)
    before = index
    new = rows_of(2, [5, 6, 70, 71])  # two changed, two added
    changed = {**texts, **new}
    gone = [0, 5, 59]  # one of them changed in the same step: it stays, as changed
    index = index.apply(table(spark, new), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    for i in (0, 59):
        del changed[i]
    same(spark, index, changed)
    same(spark, before, texts, ["w0"])  # a reader that opened earlier sees what it opened
    assert [s.rows for s in index.segments] == [60, 4] and index.segments[0].lost_rows == 4
    index = index.apply(table(spark, {5: "w9 w9", 80: None})).apply(deleted=spark.createDataFrame([(70,), (12345,)], "doc_id long"))
    changed |= {5: "w9 w9", 80: None}
    del changed[70]
    same(spark, index, changed)
    assert KeywordIndex.open(spark, index.path) == index
    small = index.compact(ratio=0.5, most=2)
    same(spark, small, changed)
    assert len(small.segments) == 2 and small.segments[0] == index.segments[0]  # the large one is not written again
    one = small.compact(ratio=0.01)
    same(spark, one, changed)
    assert [s.lost_rows for s in one.segments] == [0, 0] and one.compact() is one
    one.collect_garbage()
    same(spark, KeywordIndex.open(spark, index.path), changed, ["w1 w2"])
    none = one.apply(deleted=table(spark, changed))
    assert none.segments == () and none.scores("w0").count() == 0 and none.search("w0").count() == 0 and none.rows == 0
    again = none.apply(table(spark, {3: "w0"}))
    same(spark, again, {3: "w0"}, ["w0"])


def test_nothing_to_change(spark, tmp_path):
    index = KeywordIndex.build(table(spark, {1: "w0"}), str(tmp_path / "i"), buckets=2)
    assert index.apply() is index and index.apply(deleted=spark.createDataFrame([(9,)], "doc_id long")) is index
    with pytest.raises(FileExistsError):
        KeywordIndex.build(table(spark, {2: "w0"}), index.path)
    with pytest.raises(FileNotFoundError):
        KeywordIndex.open(spark, str(tmp_path / "other"))
    empty = KeywordIndex.build(table(spark, {}), str(tmp_path / "e"), buckets=2)
    assert empty.rows == 0 and empty.scores("w0").count() == 0 and empty.search("w0 w1").count() == 0
    same(spark, empty.apply(table(spark, {4: "w0 w1"})), {4: "w0 w1"}, ["w0"])


def test_writers_race(spark, tmp_path):
    path, failed = str(tmp_path / "i"), []
    KeywordIndex.build(table(spark, {0: "w0"}), path, buckets=2)

    def add(n):
        try:
            KeywordIndex.open(spark, path).apply(table(spark, {n: "w0", n + 1: "w1"}), spark.createDataFrame([(0,)], "doc_id long"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=add, args=(n,)) for n in (10, 20, 30)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    same(spark, KeywordIndex.open(spark, path), {n + k: f"w{k}" for n in (10, 20, 30) for k in (0, 1)}, ["w0 w1"])


def test_a_page_reads_few_bands(spark, tmp_path, monkeypatch):
    """Short rows that repeat a word score best; the scan leaves the row groups and pages of long ones out."""
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.when(F.col("id") % 97 == 0, F.lit("apple apple apple ")).when(F.col("id") % 3 == 0, F.lit("apple ")).otherwise(F.lit("")), F.when(F.col("id") % 4 == 0, F.lit("plum ")).otherwise(F.lit("")), F.repeat(F.lit("pear "), (F.col("id") % 200).cast("int"))).alias("text"),
        F.col("id").alias("size"),
        F.lit("files").alias("source_id"),
    )
    monkeypatch.setattr(KeywordIndex, "least_read", 500)
    index = KeywordIndex.build(rows, str(tmp_path / "i"), buckets=2)
    want = [(r.doc_id, round(r.score, 9)) for r in search.keyword_scores(rows, "apple plum").orderBy(F.round("score", 9), "doc_id").limit(10).collect()]
    page, read = index._best("apple plum", 10, None)
    assert [(k, s) for s, k in page] == want
    assert read["of"] > 11_000 and read["postings"] < read["of"] / 4 and read["bands"] < 16
    some = index.documents.where("size % 1000 = 999")
    page, _ = index._best("apple plum", 10, some)
    scoped = search.keyword_scores(rows, "apple plum", rows.where("size % 1000 = 999")).orderBy(F.round("score", 9), "doc_id").limit(10).collect()
    assert [(k, s) for s, k in page] == [(r.doc_id, round(r.score, 9)) for r in scoped]
    from tarnfold.operators.index import _within

    part = index.bounds(*index.looked_up(["apple"]))[:2]
    df = index._table("postings").where(index._of(["apple"]) & _within(part)).select("doc_id", "tf")
    plan = df._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(length" in plan.toString() or "LessThanOrEqual(length" in plan.toString()
    kept = df.count()
    assert 0 < kept < 6_667 / 4


def test_a_compacted_segment_is_made_of_the_rows_tokens(spark, tmp_path, monkeypatch):
    """Neither changes nor compaction read postings: living rows and their tokens are joined with the dead, and inverted again."""
    texts = rows_of(7, range(40))
    index = KeywordIndex.build(table(spark, texts), str(tmp_path / "i"), buckets=2).apply(table(spark, {3: "w0 w0", 50: "w1"}))
    monkeypatch.setattr(KeywordIndex, "_postings", lambda self: 1 / 0)
    one = index.compact(ratio=0.01, most=1)
    monkeypatch.undo()
    assert len(one.segments) == 1
    same(spark, one, {**texts, 3: "w0 w0", 50: "w1"}, ["w0 w3"])


def test_lists_of_the_dead_hold_keys_and_no_texts(spark, tmp_path):
    """So they stay small and go to the rows, instead of the rows' tokens into a shuffle; frequencies stay exact."""
    texts = rows_of(8, range(60))
    index = KeywordIndex.build(table(spark, texts), str(tmp_path / "i"), buckets=2).apply(table(spark, {3: "w0 w0", 70: "w1"}), spark.createDataFrame([(5,)], "doc_id long"))
    dead = spark.read.parquet(f"{index.path}/dead")
    assert "__tokens" not in dead.columns and sorted(r.doc_id for r in dead.collect()) == [3, 5]
    del texts[5]
    same(spark, index, {**texts, 3: "w0 w0", 70: "w1"})


def test_terms_are_made_of_few_postings(spark, tmp_path):
    """Of a term in a band only the first posting of a deal is read for the segment's terms."""
    texts = {i: " ".join(WORDS[: 1 + i % 5]) for i in range(2000)}
    index = KeywordIndex.build(table(spark, texts), str(tmp_path / "i"), buckets=2)
    written = spark.read.parquet(f"{index.path}/postings")
    assert written.count() == 6000 and written.where("n is not null").count() < 100
    assert written.agg(F.sum("n")).first()[0] == 6000 and index.frequencies(["w0", "w4"]) == {"w0": 2000, "w4": 400}


def test_postings_are_written_without_a_sort_by_folder(spark, tmp_path):
    """Deals are in that order already; the session's setting is as before, also where it is the user's own."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    rows = table(spark, rows_of(9, range(300)))
    for n, own in enumerate((None, "3")):
        if own:
            spark.conf.set(name, own)
        try:
            index = KeywordIndex.build(rows, str(tmp_path / f"i{n}"), buckets=8)
            assert spark.conf.get(name, None) == own
        finally:
            spark.conf.unset(name)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        ran = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [ran.apply(k).physicalPlanDescription() for k in range(ran.size())]
        plans = [p for p in plans if f"i{n}/postings" in p and "InsertIntoHadoopFsRelationCommand" in p and "MapInArrow" in p]
        assert len(plans) == 1 and "Sort" not in plans[0]
        folders = list((tmp_path / f"i{n}" / "postings").glob("segment=*/bucket=*"))
        assert len(folders) == 8
        same(spark, index, rows_of(9, range(300)))
