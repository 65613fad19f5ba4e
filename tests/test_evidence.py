import pytest

from tarnfold.operators import evidence


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(1, i, 10 + i, f"t{i}", f"h{i % 2}", i % 2 == 0) for i in range(6)] + [(2, 0, 99, "x", "h9", True)], "doc_id long, ordinal long, chunk_id long, text string, hash string, semantic boolean")


def test_neighbours_stay_in_the_document(spark, chunks):
    anchors = spark.createDataFrame([(1, 10), (1, 14), (2, 99)], "doc_id long, chunk_id long")
    rows = evidence.neighbours(chunks, anchors, 1, 2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.anchor, []).append(r.chunk_id)
    assert {k: sorted(v) for k, v in by.items()} == {10: [10, 11, 12], 14: [13, 14, 15], 99: [99]}
    with pytest.raises(ValueError):
        evidence.neighbours(chunks, anchors, 6, 0)


def test_fetch_pages(chunks):
    page = evidence.fetch_page(chunks, 1, 2, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in page] == [12, 13] and page[0].next_offset == 4
    assert evidence.fetch_page(chunks, 1, 4, 5).collect()[0].next_offset is None
    assert evidence.fetch_page(chunks, 77).count() == 0


def test_coverage(spark, chunks):
    vectors = spark.createDataFrame([("h0",), ("h0",)], "hash string")
    assert tuple(evidence.coverage(chunks, vectors).first()) == (7, 4, 3)


def test_retry_and_backoff(spark):
    rows = spark.createDataFrame([(0, False), (2, False), (9, False), (3, True)], "n int, c boolean")
    from pyspark.sql import functions as F

    out = [tuple(r) for r in rows.select(evidence.retry_delay(F.col("n"), F.col("c"), 1.0), evidence.sync_backoff(F.col("n"), 100)).collect()]
    assert [x[0] for x in out] == [5.0, 20.0, 80.0, 0.5] and out[2][1] == 3200.0


def test_diagnosis_ladder(spark):
    base = dict(in_scope=True, exists=True, readable=True, is_directory=False, size=1, mtime_ns=1, identity="a", content_allowed=True)
    cases = {
        "out": dict(in_scope=False), "gone": dict(exists=False), "locked": dict(readable=False), "dir": dict(is_directory=True), "new": {}, "legacy": {}, "swapped": dict(identity="b"),
        "old": dict(size=2), "excluded": dict(content_allowed=False), "pending": {}, "ok": {},
    }
    columns = ["path", *base]
    asked = spark.createDataFrame([tuple([p] + list({**base, **c}.values())) for p, c in cases.items()], "path string, in_scope boolean, exists boolean, readable boolean, is_directory boolean, size long, mtime_ns long, identity string, content_allowed boolean")
    assert asked.columns == columns
    known = spark.createDataFrame([(p, "pending" if p == "pending" else "ready", 1, 1, None if p == "legacy" else "a") for p in cases if p != "new"], "path string, status string, size long, mtime_ns long, identity string")
    got = {r.path: r.code for r in evidence.diagnose(asked, known).collect()}
    assert got == {
        "out": "excluded_or_outside_scope", "gone": "missing_or_moved", "locked": "permission_denied_or_unavailable", "dir": "directory_coverage", "new": "not_discovered",
        "legacy": "legacy_identity_unverified", "swapped": "replaced_file", "old": "stale", "excluded": "content_excluded", "pending": "content_pending", "ok": "ready",
    }


def test_query_evidence_of_ready_paths(spark):
    found = spark.createDataFrame([("/a/Plan.txt", "ready"), ("/a/b.txt", "ready"), ("/a/c.txt", "ready"), ("/a/plan2.txt", "stale"), ("/a/none.txt", "not_discovered")], "path string, code string")
    documents = spark.createDataFrame([("/a/Plan.txt", 1), ("/a/b.txt", 2), ("/a/c.txt", 3), ("/a/plan2.txt", 4)], "path string, doc_id long")
    chunks = spark.createDataFrame([(1, "other"), (2, "a PLAN here"), (2, "plan"), (3, "planet"), (3, None), (4, "plan")], "doc_id long, text string")
    got = {r.path: (r.keyword_match, r.filename_match, r.query_assessment, r.actions) for r in evidence.query_evidence(evidence.with_actions(found), documents, chunks, "plan").collect()}
    missed = "no_keyword_match_in_indexed_content"
    assert got == {
        "/a/Plan.txt": (False, True, "match", ["fetch"]), "/a/b.txt": (True, False, "match", ["fetch"]), "/a/c.txt": (False, False, missed, ["fetch"]),
        "/a/plan2.txt": (None, None, None, ["refresh_path"]), "/a/none.txt": (None, None, None, ["prioritize_path"]),
    }
    assert {r.query_assessment for r in evidence.query_evidence(found.limit(1), documents, chunks, "??").collect()} == {missed}


def test_recall(spark):
    hits = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 7)], "case_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 6), (2, 7), (3, 9)], "case_id int, doc_id int")
    cases = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "case_id int, group string")
    r = evidence.recall(hits, relevant, cases).first()
    assert (r.cases, r.recall_5, r.recall_10, r.mean_first_rank) == (3, 1 / 3, 2 / 3, 4.0)


def test_fair_selection_keeps_a_quarter_for_old_work(spark):
    work = spark.createDataFrame([(i, i, 0, 1) for i in range(10)] + [(i, i, 0, 0) for i in range(10, 20)], "doc_id long, available_at long, attempts int, priority int")
    got = [r.doc_id for r in evidence.fair_selection(work, 8).collect()]
    assert set(got[:2]) == {10, 11} and got[2:] == [0, 1, 2, 3, 4, 5]
