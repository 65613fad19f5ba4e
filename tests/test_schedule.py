import os
import threading

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import maintain, schedule, sync


def test_paused_indexer_takes_nothing(spark):
    queue = spark.createDataFrame([(i, 0.0, 0, 0) for i in range(9)], "doc_id long, available_at double, attempts int, priority int")
    documents = spark.range(5).withColumnRenamed("id", "doc_id")
    assert [r.doc_id for r in schedule.due_files(queue, documents, 1, 3).collect()] == [0, 1, 2]
    assert schedule.due_files(queue, documents, 1, 3, paused=True).count() == 0


def test_failed_file_waits_and_the_batch_replays(spark):
    queue = spark.createDataFrame([(1, 0.0, 0, 0), (2, 0.0, 2, 0), (3, 9.0, 0, 1)], "doc_id long, available_at double, attempts int, priority int")
    outcome = spark.createDataFrame([(1, False), (2, True)], "doc_id long, failed boolean")
    got = {r.doc_id: (r.available_at, r.attempts) for r in schedule.commit_batch(queue, outcome, 100.0).collect()}
    assert got == {1: (0.0, 0), 2: (340.0, 3), 3: (9.0, 0)}
    fine = schedule.commit_batch(queue, outcome.where("not failed"), 100.0)
    assert sorted(r.doc_id for r in fine.collect()) == [2, 3]
    assert schedule.commit_batch(queue, outcome.limit(0), 100.0).count() == 3


def test_local_files_skip_links_and_carry_identities(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    for name in ("top.txt", "a/one.txt", "a/b/two.txt", "skip/no.txt"):
        (tmp_path / name).write_text(name)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "top.txt", tmp_path / "a" / "link.txt")
    rows = schedule.local_files(spark, [str(tmp_path)], [str(tmp_path / "skip")]).collect()
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in rows) == ["a/b/two.txt", "a/one.txt", "top.txt"]
    for r in rows:
        s = os.stat(r.path)
        assert (r.size, r.mtime_ns, r.identity) == (s.st_size, s.st_mtime_ns, f"{s.st_dev}:{s.st_ino}")
    (tmp_path / "empty").mkdir()
    assert schedule.local_files(spark, [str(tmp_path / "empty")]).count() == 0


def test_discovery_deals_open_folders_anew(spark, tmp_path):
    """One root with a wide level below a deep one, scanned by several tasks in a few rounds."""
    deep = tmp_path / "root"
    for k in range(60):
        deep = deep / f"{k}"
    deep.mkdir(parents=True)
    want = set()
    for k in range(120):
        (deep / f"w{k}").mkdir()
        (deep / f"w{k}" / "f.txt").write_text("x" * k)
        want.add(str(deep / f"w{k}" / "f.txt"))
    (tmp_path / "single.md").write_text("s")
    d = schedule.discover(spark, [str(tmp_path / "root"), str(tmp_path / "root" / "0"), str(tmp_path / "single.md")], slices=8, first=8, most=32)
    rows = d.files.collect()
    assert {r.path for r in rows} == want | {str(tmp_path / "single.md")} and len(rows) == len(want) + 1
    assert d.complete and d.rounds >= 4 and {r.generation for r in rows} == {d.generation}
    last = spark.read.parquet(d.files.inputFiles()[0].rsplit("/round=", 1)[0] + f"/round={d.rounds}")
    assert last.where("kind = 'file'").rdd.glom().filter(lambda x: len(x) > 0).count() > 1  # several tasks' files


def test_discovery_with_errors_is_not_complete(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_text("x")
    d = schedule.discover(spark, [str(tmp_path), str(tmp_path.parent / "not there")])
    assert not d.complete and [r.error for r in d.errors.collect()] == ["FileNotFoundError"] and d.files.count() == 1
    gone = spark.createDataFrame([("/old",)], "path string")
    assert maintain.sweep(gone, d.files, d.complete, "path").count() == 0
    assert schedule.discover(spark, [str(tmp_path / "a")], [str(tmp_path / "a")]).files.count() == 0


def test_watcher_needs_roots(spark):
    events = spark.createDataFrame([("/a/x", False, 1), ("/a/x", True, 5), ("/ab", False, 2)], "path string, is_directory boolean, at long")
    assert [tuple(r) for r in schedule.watched_events(events, ["/a"]).collect()] == [("/a/x", True, 2, 1, 5)]
    for roots in ([], ["/r"] * 33):
        with pytest.raises(ValueError):
            schedule.watched_events(events, roots)


def test_publishers_race_and_readers_always_find_a_version(spark, tmp_path):
    s = maintain.Snapshot(spark, str(tmp_path / "index"))
    s.publish(spark.range(1))
    failed, seen = [], []

    def publish(n):
        try:
            maintain.Snapshot(spark, s.base).publish(spark.range(n))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=publish, args=(n,)) for n in range(2, 6)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        seen.append(s.read().count())
    assert not failed and set(seen) <= {1, 2, 3, 4, 5}
    m = s.manifest()
    assert m["generation"] == 5 and s._numbers() == [1, 2, 3, 4, 5]
    assert len(s.collect_garbage()) == 3 and s._numbers() == [5] and s.read("previous").count() > 0


def test_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    s = maintain.Snapshot(spark, str(tmp_path / "index"))
    s.publish(spark.range(3))
    monkeypatch.setattr(s, "_claim", lambda new: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        s.publish(spark.range(9))
    assert maintain.Snapshot(spark, s.base).read().count() == 3


def test_page_is_what_its_cursor_passed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10, 20, numPartitions=1).write.parquet(path)
    page, state, _ = sync.TableSync(spark.read.parquet(path), "id", size=4).page(sync.Checkpoint(), 0.0)
    spark.range(0, 10, numPartitions=1).write.mode("append").parquet(path)  # rows that come in between
    assert [r.id for r in page.collect()] == [10, 11, 12, 13] and state.cursor == 13


def test_whole_cycle_ends_at_its_boundary(spark):
    rows = spark.createDataFrame([(i, i // 4) for i in range(30)], "id long, u long")
    whole, state = sync.TableSync(rows, "id", "u").cycle(7.0)
    assert whole.count() == 30 and state.watermark == (7, 29) and state.last_full == 7.0
    none, state = sync.TableSync(rows.limit(0), "id", "u").cycle(7.0)
    assert none.count() == 0 and state.watermark is None


def test_snapshot_markers_say_why(spark):
    rows = {"whole": (spark.range(3), "id"), "long": (spark.range(9), "id"), "odd": (spark.createDataFrame([(1,), (None,)], "id long"), "id"), "empty": (spark.range(0), "id")}
    got = sync.snapshot_rows(rows, 4)
    assert {r.table: (r.complete, r.reason) for r in got.where("row_id is null").collect()} == {"whole": (True, None), "long": (False, "row_limit"), "odd": (False, "null_key"), "empty": (True, None)}
    assert {r.table: r["count"] for r in got.where("row_id is not null").groupBy("table").count().collect()} == {"whole": 3, "long": 4, "odd": 1}


def test_sensitive_names_fold(spark):
    rows = spark.createDataFrame([("/a/.ſsh/x",), ("/a/.ßH/x",), ("/a/CREDENTIALS",), ("/a/credentials.txt",)], "p string")
    assert [r[0] for r in rows.select(maintain.is_sensitive(F.col("p"))).collect()] == [True, True, True, False]
