from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.operators import maintain


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_chunk_diff_is_a_multiset_diff(spark, old, new):
    a = spark.createDataFrame([(1, i, i, h) for i, h in enumerate(old)], "doc_id long, chunk_id long, ordinal long, hash string")
    b = spark.createDataFrame([(1, i, h) for i, h in enumerate(new)], "doc_id long, ordinal long, hash string")
    rows = maintain.chunk_diff(a, b).collect()
    actions = Counter((r.action, r.hash) for r in rows)
    o, n = Counter(old), Counter(new)
    for h in "abc":
        assert actions["reused", h] == min(o[h], n[h])
        assert actions["removed", h] == max(0, o[h] - n[h]) and actions["written", h] == max(0, n[h] - o[h])
    kept = sorted((r.chunk_id, r.new_ordinal) for r in rows if r.action == "reused")
    for h in "abc":  # copies pair in order
        pairs = [(c, k) for c, k in kept if old[c] == h]
        assert pairs == sorted(pairs) and [k for _, k in pairs] == sorted(k for _, k in pairs)


def test_queues_are_set_algebra(spark):
    chunks = spark.createDataFrame([(1, "a", "t", True), (2, "a", "t", True), (3, "b", "u", False), (4, "c", "v", True)], "chunk_id long, hash string, text string, semantic boolean")
    vectors = spark.createDataFrame([("c", "m"), ("b", "m"), ("z", "m"), ("a", "old")], "hash string, model string")
    assert [r.hash for r in maintain.pending_embeddings(chunks, vectors, "m").collect()] == ["a"]
    assert sorted(r.hash for r in maintain.orphan_embeddings(vectors, chunks).collect()) == ["b", "z"]
    members = spark.createDataFrame([(1, "a", 0), (9, "q", 0), (8, "q", 1)], "chunk_id long, hash string, segment int")
    assert sorted(r.chunk_id for r in maintain.missing_members(chunks, vectors, members).collect()) == [2, 4]
    ratios = maintain.live_ratio(members, chunks)
    assert {r.segment: (r.total, r.live) for r in ratios.collect()} == {0: (2, 1), 1: (1, 0)}
    assert maintain.compaction_plan(ratios) == {"drop": [1], "rewrite": [0], "merge": []}


def test_compaction_merges_smallest(spark):
    ratios = spark.createDataFrame([(i, 100 + i, 100 + i) for i in range(12)], "segment int, total long, live long")
    plan = maintain.compaction_plan(ratios)
    assert plan["merge"] == [0, 1, 2, 3, 4] and not plan["drop"] and not plan["rewrite"]


def test_upsert_and_sweep(spark):
    known = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "3", 1, 1), ("d", "4", 1, 1)], "key string, identity string, size long, mtime_ns long")
    seen = spark.createDataFrame([("a", "1", 1, 1), ("b", "9", 1, 1), ("c", "3", 2, 1), ("e", "5", 1, 1)], "key string, identity string, size long, mtime_ns long")
    got = {r.key: r.action for r in maintain.metadata_upsert(known, seen).collect()}
    assert got == {"a": "same", "b": "replaced", "c": "changed", "d": "unseen", "e": "new"}
    assert [r.key for r in maintain.sweep(known, seen, True).collect()] == ["d"]
    assert maintain.sweep(known, seen, False).count() == 0


def test_scope():
    assert maintain.minimal_roots(["/a/b", "/a", "/c/", "/ab"]) == ["/a", "/ab", "/c"]


def test_scope_columns(spark):
    rows = spark.createDataFrame([("/a/x",), ("/ab/x",), ("/a/no/x",), ("/a/.ssh/x",), ("/a/.env.local",)], "p string")
    p = F.col("p")
    out = [tuple(r) for r in rows.select(maintain.in_scope(p, ["/a"], ["/a/no"]), maintain.is_sensitive(p)).collect()]
    assert out == [(True, False), (False, False), (False, False), (True, True), (True, True)]
    assert not rows.select(maintain.in_scope(p, [], mode="none")).first()[0] and rows.select(maintain.in_scope(p, [], mode="all")).first()[0]


def test_snapshot_publication(spark, tmp_path):
    s = maintain.Snapshot(spark, str(tmp_path / "index"))
    assert s.manifest()["current"] is None
    s.publish(spark.range(3))
    reader = s.read()
    s.publish(spark.range(5))
    assert reader.count() == 3 and s.read().count() == 5 and s.read("previous").count() == 3
    s.publish(spark.range(7))
    assert len(s.collect_garbage()) == 1 and s.read().count() == 7 and s.manifest()["generation"] == 3
    s.compact(1)
    assert s.read().count() == 7


def test_scope_by_names_and_aliases(spark):
    paths = ["/r/a/x", "/r/Node_Modules/x", "/r/a/node_modules", "/r/a/node_modules2/x", "/node_modules/r/x", "/r", "/rest/x", "/link/x"]
    rows = spark.createDataFrame([(p, "/r/a/y" if p == "/link/x" else p) for p in paths], "p string, real string")

    def inside(*args, **more):
        return [r.p for r in rows.where(maintain.in_scope(F.col("p"), *args, **more)).collect()]

    names = ["NODE_modules"]
    assert inside(["/r/"], names=names) == ["/r/a/x", "/r/a/node_modules2/x", "/r"]
    assert inside(["/node_modules/r"], names=names) == ["/node_modules/r/x"]  # what is above a root does not count
    assert inside([], mode="all", names=names, resolved=F.col("real")) == ["/r/a/x", "/r/a/node_modules2/x", "/r", "/rest/x"]
    assert inside(["/"], ["/r"]) == ["/node_modules/r/x", "/rest/x", "/link/x"]
    assert inside(["/r"], mode="none") == []
    with pytest.raises(ValueError):
        inside(["/r"], mode="some")


def test_full_case_folding(spark):
    names = ["Stra\u00dfe", "\u03a3\u03a5\u03a3", "\ufb01le", "\u0149a", "\u017fum", "\u0130", "\u1e9e", "\u0390", "plain.TXT", "\u13a0\uab70", "\u01c5", "\U00010400", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.folded for r in rows.select("name", maintain.casefolded(F.col("name")).alias("folded")).collect()}
    assert got == {n: n.casefold() for n in names}
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    rows = spark.createDataFrame([(c,) for c in every], "c string").repartition(4)
    assert all(r.f == r.c.casefold() for r in rows.select("c", maintain.casefolded(F.col("c")).alias("f")).collect())
    out = rows.select(maintain.in_scope(F.lit("/d/\u03a3\u03b1\u03c2/x"), ["/d"], names=["\u03c3\u0391\u03a3"]).alias("ok")).first()
    assert not out.ok
