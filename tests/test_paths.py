"""The path index against a scan of all paths."""

import pytest

from tarnfold.library import Library
from tarnfold.operators import search
from tarnfold.operators.paths import FEW, PathIndex

SCHEMA = "doc_id long, path string, name string, source_id string, extension string, size long, mtime_ns long"
NAMES = ["Report.TXT", "report.txt", "a.md", "ab", "数据库.md", "数据.txt", "é.txt", "x%_!.csv", "IİK.txt", "aaaa.py"]


def rows_of(spark, paths):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1], "files", ".txt", i, i * 7 % 5) for i, p in paths.items()], SCHEMA)


@pytest.fixture(scope="module")
def paths():
    return {i: f"/d{i % 3}/Sub{i % 7}/{NAMES[i % len(NAMES)]}" for i in range(80)}


QUERIES = ["report", "REPORT.txt", "sub3/re", "数", "数据", "数据库", "ab", "a", "%_!", "é.t", "K.t", "aaa", "aaaaa", "nowhere", "/d1/sub4/report.txt", "/"]


def same(spark, index, paths, queries=QUERIES):
    rows = rows_of(spark, paths)
    for q in queries:
        for filters, sort in ((None, "relevance"), (search.Filters(min_size=30, file_source=None), "modified_desc")):
            want = [r.doc_id for r in search.filename_search(rows, q, 100, filters, sort).collect()]
            assert [r.doc_id for r in index.search(q, 100, filters, sort).collect()] == want, q


def test_equal_to_a_scan(spark, tmp_path, paths):
    index = PathIndex.build(rows_of(spark, paths), str(tmp_path / "p"), buckets=2)
    same(spark, index, paths)
    assert PathIndex.open(spark, str(tmp_path / "p")) == index
    moved = {**paths, 3: "/new/place.txt", 200: "/new/数据/report"}
    gone = [7, 8]
    index = index.apply(rows_of(spark, {k: moved[k] for k in (3, 200)}), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    for k in gone:
        del moved[k]
    same(spark, index, moved, ["report", "数", "ab", "/d1/sub4/report.txt"])
    library = Library(rows_of(spark, moved), None, paths=index.compact(0.01, 1))
    assert [r.doc_id for r in library.search("new/数", "files").collect()] == [200]


def test_only_candidates_are_read(spark, tmp_path):
    paths = {i: f"/many/folder{i % 50}/file{i}.txt" for i in range(5000)}
    index = PathIndex.build(rows_of(spark, paths), str(tmp_path / "p"), buckets=4)
    df = index.narrowed("file4321")
    assert df.count() <= 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in plan or "EqualTo(doc_id" in plan or "doc_id IN" in plan or "doc_id INSET" in plan
    assert index.narrowed("zzz").count() == 0 and index.narrowed("q").count() == 5000
    assert index.narrowed("file").count() == 5000 > FEW
    assert [r.doc_id for r in index.search("file4321").collect()] == [4321]
