import pytest
from pyspark.sql import functions as F

from tarnfold.library import Library
from tarnfold.operators.index import KeywordIndex
from tarnfold.operators.search import Filters
from tarnfold.plans.structured import Source


@pytest.fixture(scope="module", params=["scanned", "indexed"])
def library(spark, request, tmp_path_factory):
    documents = spark.createDataFrame(
        [(i, "files", f"/d/{n}", n, ".txt", 10 * i, i, "ready", 1.0) for i, n in enumerate(["apple.txt", "b.txt", "c.txt", "d.txt"])],
        "doc_id long, source_id string, path string, name string, extension string, size long, mtime_ns long, status string, indexed_at double",
    )
    texts = {0: ["nothing here", "green tree"], 1: ["apple pie and apple cake", "apple"], 2: ["apple", "other words"], 3: ["apple", "other words"]}
    chunks = spark.createDataFrame([(10 * d + k, d, k, t, f"h{t}", True) for d, ts in texts.items() for k, t in enumerate(ts)], "chunk_id long, doc_id long, ordinal long, text string, hash string, semantic boolean")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (10, [0.0, 1.0]), (20, [0.7, 0.7]), (30, [0.7, 0.7])], "chunk_id long, embedding array<double>")
    index = KeywordIndex.build(chunks, str(tmp_path_factory.mktemp("library") / "i"), "chunk_id", buckets=2) if request.param == "indexed" else None
    return Library(documents, chunks, vectors, {"s": Source({"t": spark.range(3)})}, lambda q: [1.0, 0.0], index)


def test_an_index_means_no_scan_of_texts(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i // 3, i, f"w{i % 5} w{i % 7}", f"h{i}", True) for i in range(60)], CHUNKS)
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    documents = spark.createDataFrame([(i, "files", f"/d/{i}", f"{i}", ".txt", i, i, "ready", 1.0) for i in range(20)], DOCUMENTS)
    with_index = Library(documents, chunks, index=KeywordIndex.build(chunks, str(tmp_path / "i"), "chunk_id", buckets=2))
    page = with_index.search("w1 w2", "keyword", 5)
    assert "text" not in page._jdf.queryExecution().executedPlan().toString().replace("Text", "")
    assert [tuple(r) for r in page.collect()] == [tuple(r) for r in Library(documents, chunks).search("w1 w2", "keyword", 5).select(page.columns).collect()]


def test_one_document_of_very_many_chunks(spark, tmp_path):
    """A document whose chunks fill the head of every list: the others are found behind them."""
    n = 100_000
    big = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit(0).cast("long").alias("doc_id"), F.col("id").alias("ordinal"), F.lit("apple").alias("text"), F.lit("h").alias("hash"), F.lit(True).alias("semantic"))
    rest = spark.range(40).select((F.col("id") + n).alias("chunk_id"), (F.col("id") + 1).alias("doc_id"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("apple "), F.repeat(F.lit("pear "), F.col("id").cast("int"))).alias("text"), F.lit("r").alias("hash"), F.lit(True).alias("semantic"))
    chunks = big.unionByName(rest)
    vectors = chunks.select("chunk_id", F.when(F.col("doc_id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.col("doc_id") / 10)).alias("embedding"))
    documents = spark.range(41).select(F.col("id").alias("doc_id"), F.lit("files").alias("source_id"), F.lit("/p").alias("path"), F.concat(F.lit("n"), "id").alias("name"), F.lit(".txt").alias("extension"), F.col("id").alias("size"), F.col("id").alias("mtime_ns"), F.lit("ready").alias("status"), F.lit(1.0).alias("indexed_at"))
    index = KeywordIndex.build(chunks, str(tmp_path / "i"), "chunk_id", buckets=2)
    library = Library(documents, chunks, vectors, encode=lambda q: [1.0, 0.0], index=index)
    got = library.search("apple", "hybrid", 5).collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4]
    assert all(abs(r.score - 2 / (61 + n + r.doc_id - 1)) < 1e-9 for r in got[1:])


DOCUMENTS = "doc_id long, source_id string, path string, name string, extension string, size long, mtime_ns long, status string, indexed_at double"
CHUNKS = "chunk_id long, doc_id long, ordinal long, text string, hash string, semantic boolean"


def test_keyword_gives_a_chunk_a_document(library):
    rows = library.search("apple", "keyword").collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] and {r.chunk_id for r in rows if r.doc_id != 1} == {20, 30}
    folded = {r.doc_id: r.other_locations for r in library.search("apple", "keyword", fold_duplicates=True).collect()}
    assert folded == {1: [], 2: [3]}


def test_semantic_and_hybrid(library):
    assert [r.doc_id for r in library.search("x", "semantic").collect()] == [0, 2, 3, 1]
    hybrid = library.search("apple.txt", "hybrid").collect()
    assert hybrid[0].doc_id == 0 and hybrid[0].exact and {r.doc_id for r in hybrid} == {0, 1, 2, 3}
    only = library.search("apple", "hybrid", filters=Filters(min_size=20)).collect()
    assert {r.doc_id for r in only} == {2, 3}
    assert [r.doc_id for r in library.search("apple", "hybrid", sort="modified_desc").collect()] == [3, 2, 1, 0]


def test_without_vectors(library):
    plain = Library(library.documents, library.chunks)
    assert {r.doc_id for r in plain.search("apple", "hybrid").collect()} == {1, 2, 3}
    assert plain.search("apple", "semantic").count() == 0
    assert [r.doc_id for r in plain.search("PPLE", "files").collect()] == [0]


def test_evidence_and_status(library):
    assert [r.chunk_id for r in library.fetch(1).orderBy("rank").collect()] == [10, 11]
    assert [(r.chunk_id, r.distance) for r in library.read_context(11).collect()] == [(10, -1), (11, 0)]
    status = library.index_status()
    assert status["counts"].first()["n"] == 4 and tuple(status["coverage"].first())[:2] == (8, 8)
    assert library.query_database("s", {"table": "t"})["row_count"] == 3 and library.inspect_source("s").count() == 1
    with pytest.raises(KeyError):
        library.query_database("x", {"table": "t"})
