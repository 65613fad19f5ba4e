import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import vectors
from tarnfold.sources.relational import Relational, quoted


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"t{i}", "secret") for i in range(30)], "id int, body string, hidden string")
    rows.write.format("jdbc").option("url", url).option("dbtable", '"notes"').option("createTableColumnTypes", "body VARCHAR(40), hidden VARCHAR(40)").save()
    source = Relational(f"jdbc:derby:{tmp_path}/db", {"notes": ["id", "body"]})
    df = source.table(spark, "notes")
    assert df.columns == ["id", "body"] and df.where("id >= 20").count() == 10
    parts = source.by_key_ranges(spark, "notes", "id", [10, 20])
    assert parts.rdd.getNumPartitions() == 3 and sorted(r.id for r in parts.collect()) == list(range(30))
    for bad in (lambda: source.table(spark, "other"), lambda: source.by_key_ranges(spark, "notes", "hidden", [1])):
        with pytest.raises(ValueError):
            bad()


def test_relational_configuration():
    for bad in ({"url": "x"}, {"url": "jdbc:mysql://h/d", "options": {"password": "p"}}, {"url": "jdbc:mysql://h/d", "timeout": 0}):
        with pytest.raises(ValueError):
            Relational(tables={}, **bad)
    assert quoted('a"b', "postgresql") == '"a""b"' and quoted("a`b", "mysql") == "`a``b`"
    with pytest.raises(ValueError):
        quoted("a\0", "mysql")


def test_half_precision(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, [1 / 3, 1.0])], "chunk_id long, embedding array<float>")
    back = {r.chunk_id: r.embedding for r in vectors.unpacked(vectors.packed(df, "chunk_id", dim=2), "chunk_id", 2).collect()}
    assert back[1] == [0.5, -2.0] and abs(back[2][0] - 1 / 3) < 1e-3
    single = spark.createDataFrame([(1, bytearray(np.array([1, 2], "<f4").tobytes()))], "chunk_id long, vector binary")
    assert vectors.unpacked(single, "chunk_id", 2).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="finite vector"):
        vectors.packed(df, "chunk_id", dim=3).collect()


def test_provider_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "chunk_id long, text string")
    out = {r.chunk_id: r for r in vectors.encoded(df, "chunk_id", "text", vectors.hashing_provider, "hash").collect()}
    assert out[1].embedding == out[2].embedding and out[1].model == "hash"
    assert abs(np.linalg.norm(out[1].embedding) - 1) < 1e-6 and not any(out[3].embedding)


def test_segments_and_publication(spark):
    made = vectors.segments(spark.range(100).select(F.col("id").alias("chunk_id")), 30, 7)
    sizes = {r.segment: r.n for r in made.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 100 and min(sizes) == 7 and len(sizes) <= 4
    assert vectors.should_publish(256, 0, False) and vectors.should_publish(1, 11, False) and vectors.should_publish(1, 0, True)
    assert not vectors.should_publish(0, 99, True) and not vectors.should_publish(5, 1, False)


def test_revalidation_and_authorization(spark):
    hits = spark.createDataFrame([("/a", "1"), ("/b", "1"), ("/c", "1"), ("/d", "1")], "path string, identity string")
    files = spark.createDataFrame([("/a", "1", False, True), ("/b", "2", False, True), ("/c", "1", True, True)], "path string, identity string, is_link boolean, in_scope boolean")
    assert [r.path for r in vectors.still_valid(hits, files).collect()] == ["/a"]
    schema = "source_id string, table string, id_column string, columns array<string>"
    found = spark.createDataFrame([("s", "t", "id", ["x"]), ("s", "t", "id", ["x", "z"]), ("s", "u", "id", ["x"])], schema)
    allowed = spark.createDataFrame([("s", "t", "id", ["x", "y"])], schema)
    assert [r["columns"] for r in vectors.authorized_rows(found, allowed).collect()] == [["x"]]


def test_short_path_tokens(spark):
    df = spark.createDataFrame([("/文档/文.txt",), ("/plain",)], "p string").select(vectors.short_path_tokens(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == ["文 文档 档", ""]
