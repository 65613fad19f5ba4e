import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import segments
from tarnfold.operators.segments import VectorSegments


def chunks(spark, ids, semantic=True):
    return spark.createDataFrame([(i, f"h{i % 50}", semantic) for i in ids], "chunk_id long, hash string, semantic boolean")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(f"h{i}", [float(i % 7) - 3, float(i % 11) - 5, 1.0]) for i in range(45)], "hash string, embedding array<float>")


def keys(df):
    return sorted(r.chunk_id for r in df.select("chunk_id").collect())


def test_segments_grow_retire_and_merge(spark, tmp_path, vectors):
    s = VectorSegments(spark, str(tmp_path / "v"), capacity=20, ratio=0.3, most=4)
    assert s.rows().count() == 0 and s.compact(chunks(spark, [1])) == s.manifests.manifest()
    has = [i for i in range(100) if i % 50 < 45]
    assert len(s.add(chunks(spark, range(100)), vectors)["segments"]) == 5  # 90 rows by 20
    assert keys(s.rows()) == has
    again = s.add(chunks(spark, range(100)), vectors)
    assert again["generation"] == 1  # all are covered: nothing is published
    s.add(chunks(spark, range(100, 110)), vectors)
    s.add(chunks(spark, [200], semantic=False), vectors)
    assert s.rows().count() == 100 and s.manifests.manifest()["generation"] == 2
    left = [i for i in has if i >= 60 or i % 10 == 0]  # most of the first three segments are gone
    new = s.compact(chunks(spark, left))
    assert keys(s.live(chunks(spark, left))) == left and len(new["segments"]) <= 4
    dead = s.rows().count() - len(left)
    assert dead < 0.3 * s.rows().count()
    gone = s.collect_garbage()
    assert keys(s.live(chunks(spark, left))) == left and not gone  # the manifest before still lists them
    s.compact(chunks(spark, []))
    assert s.rows().count() == 0
    assert keys(s.live(chunks(spark, left))) == []


def test_search_is_exact_and_live(spark, tmp_path, vectors):
    s = VectorSegments(spark, str(tmp_path / "v"), capacity=9)
    every = chunks(spark, range(60))
    s.add(every, vectors)
    kept = every.where("chunk_id % 3 != 0")
    query, of = [1.0, 2.0, 0.5], {r.hash: r.embedding for r in vectors.collect()}

    def distance(i):
        v = of[f"h{i % 50}"]
        dot, size = sum(a * b for a, b in zip(query, v, strict=True)), sum(a * a for a in v) ** 0.5 * sum(a * a for a in query) ** 0.5
        return round(1 - dot / size, 6)

    for where, test in ((None, lambda i: True), (F.col("chunk_id") > 20, lambda i: i > 20)):
        want = sorted((distance(i), i) for i in range(60) if i % 3 and i % 50 < 45 and test(i))[:8]
        got = [(r.distance, r.chunk_id) for r in s.search(query, 8, kept, where, whole=True).collect()]
        assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want, strict=True))


def test_writers_race(spark, tmp_path, vectors):
    """Writers that start from the same manifest cover every chunk once."""
    path, failed = str(tmp_path / "v"), []

    def add(n):
        try:
            VectorSegments(spark, path).add(chunks(spark, range(n, n + 30)), vectors)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=add, args=(n,)) for n in (0, 15)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and keys(VectorSegments(spark, path).rows()) == list(range(45))


def test_limits():
    for bad in ({"capacity": 0}, {"most": 0}, {"ratio": 0}):
        with pytest.raises(ValueError):
            VectorSegments(None, "x", **bad)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """3,000 vectors of 32 dimensions around 40 directions, in two passes, some without direction."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    v[[7, 1999]] = 0
    every = spark.createDataFrame([(i, f"h{i}", True) for i in range(3000)], "chunk_id long, hash string, semantic boolean")
    vectors = spark.createDataFrame([(f"h{i}", x.tolist()) for i, x in enumerate(v)], "hash string, embedding array<float>")
    s = VectorSegments(spark, str(tmp_path_factory.mktemp("cells") / "v"), capacity=300)
    s.add(every.where("chunk_id < 2000"), vectors)
    s.add(every, vectors)
    return s, every, v


def truth(v, q, limit, keep=None):
    q = np.asarray(q, np.float64)
    w = v.astype(np.float32).astype(np.float64)
    size = np.sqrt((w * w).sum(1)) * np.sqrt((q * q).sum())
    d = np.round(np.where(size == 0, 1, 1 - w @ q / np.where(size == 0, 1, size)), 6)
    ids = np.arange(len(v)) if keep is None else np.flatnonzero(keep)
    return sorted((float(d[i]), int(i)) for i in ids)[:limit]


def test_cells_recall_and_pruning(spark, clustered):
    s, every, v = clustered
    queries = v[::100] + 0.3 * np.random.default_rng(1).normal(size=v[::100].shape)
    got = {}
    for r in s.search_batch(queries, 10, every).collect():
        got.setdefault(r.query_no, set()).add(r.chunk_id)
    recall = np.mean([len(got[i] & {k for _, k in truth(v, q, 10)}) / 10 for i, q in enumerate(queries)])
    assert recall >= 0.95
    manifest = s.manifests.manifest()
    cells = s.cells(manifest)
    near = np.flatnonzero(cells.chosen(cells.angles(np.array([queries[0] / np.linalg.norm(queries[0])])), None)[0])
    plan = s._in(manifest, cells, near)
    assert plan.count() == cells.sizes[near].sum() < 1000  # of 3,000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "In(cell" in text or "EqualTo(cell" in text


def test_certain_pages_are_exact(spark, clustered):
    s, every, v = clustered
    some = every.where("chunk_id % 7 <> 0")
    queries = np.concatenate([v[:12] + 0.1, np.zeros((1, 32)), -v[20:22]])
    batch = {}
    for r in s.search_batch(queries, 10, some, probes=2, certain=True).collect():
        batch.setdefault(r.query_no, []).append((r["rank"], r.distance, r.chunk_id))
    for i, q in enumerate(queries):
        want = truth(v, q, 10, np.arange(3000) % 7 != 0)
        rows = [(d, k) for _, d, k in sorted(batch[i])]
        assert [k for _, k in rows] == [k for _, k in want] and np.allclose([d for d, _ in rows], [d for d, _ in want], atol=2e-6)
    one = s.search(queries[0].tolist(), 10, every, F.col("chunk_id") % 7 != 0, probes=2, certain=True).collect()
    assert [r.chunk_id for r in one] == [k for _, k in truth(v, queries[0], 10, np.arange(3000) % 7 != 0)]
    rare = s.search(queries[0].tolist(), 5, every, F.col("chunk_id") % 500 == 3, probes=1).collect()  # more cells until the page is full
    assert len(rare) == 5
    assert s.search([0.0] * 32, 3, every, probes=2).count() == 3


def test_noise_needs_most_cells():
    rng = np.random.default_rng(0)
    noise, near = rng.normal(size=(2000, 32)), np.repeat(rng.normal(size=(40, 32)), 50, 0) + 0.05 * rng.normal(size=(2000, 32))
    assert segments.needed_probes(noise, segments.learn(noise, 44)) > 15 and segments.needed_probes(near, segments.learn(near, 44)) <= 4
    assert segments.needed_probes(np.zeros((3, 2)), np.zeros((0, 2))) == 1


def test_cells_of_nothing(spark, tmp_path):
    s = VectorSegments(spark, str(tmp_path / "v"))
    none = spark.createDataFrame([], "chunk_id long, hash string, semantic boolean")
    assert s.search([1.0, 0.0], 3, none, probes=2).count() == 0 and s.search_batch(np.ones((2, 2)), 3, none).count() == 0
    one = spark.createDataFrame([(1, "a", True)], none.schema)
    s.add(one, spark.createDataFrame([("a", [0.0, 0.0])], "hash string, embedding array<float>"))
    assert [(r.chunk_id, r.distance) for r in s.search([1.0, 0.0], 3, one, probes=2).collect()] == [(1, 1.0)]


def test_a_pass_has_no_more_segments_than_allowed(spark, tmp_path):
    s = VectorSegments(spark, str(tmp_path / "v"), capacity=2)
    every = spark.range(400).select(F.col("id").alias("chunk_id"), F.col("id").cast("string").alias("hash"), F.lit(True).alias("semantic"))
    made = s.add(every, every.select("hash", F.array(F.sin("chunk_id"), F.cos("chunk_id")).cast("array<float>").alias("embedding")))
    assert len(made["segments"]) <= 64 and sum(n for _, _, n in made["segments"]) == 400
