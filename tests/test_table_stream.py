"""A table as a stream: full and incremental cycles, restarts, sweeps, in tasks' ranges."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import maintain
from tarnfold.streaming import tables
from tarnfold.streaming.tables import table_source


@pytest.fixture
def db(tmp_path):
    path, hours = str(tmp_path / "t.db"), tmp_path / "hour"
    hours.write_text("0")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, body TEXT, changed INTEGER, secret TEXT)")
        c.executemany("INSERT INTO items VALUES (?, ?, ?, 's')", [(i, f"b{i}", i // 10) for i in range(100)])
    return path, hours


def run(spark, db, tmp_path, name, **options):
    """All that the query has read after one more start."""
    path, hours = db
    spark.dataSource.register(table_source(name, lambda: sqlite3.connect(path), clock=lambda: 3600.0 * int(hours.read_text())))
    out = tmp_path / f"{name}-out"
    s = spark.readStream.format(name).option("table", "items").option("key", "id").option("columns", "id,body").option("size", 30)
    for k, v in options.items():
        s = s.option(k, v)
    q = s.load().withColumn("part", F.spark_partition_id()).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(out)).collect()


def ids(rows, kind="row"):
    return sorted(int(r.row_id) for r in rows if r.kind == kind)


def change(db, *statements):
    with sqlite3.connect(db[0]) as c:
        for s in statements:
            c.execute(s)


def test_cycles_and_restarts(spark, db, tmp_path):
    first = run(spark, db, tmp_path, "cycles", updated="changed")
    assert ids(first) == list(range(100)) and [r.kind for r in first].count("complete") == 1
    assert len({r.part for r in first}) == 4  # ranges of 30 keys, a task each
    assert {tuple(json.loads(r.row)) for r in first if r.kind == "row"} == {("id", "body")}
    assert len(run(spark, db, tmp_path, "cycles", updated="changed")) == len(first)  # nothing changed: nothing is read
    change(db, "UPDATE items SET body = 'new', changed = 20 WHERE id IN (5, 50)", "INSERT INTO items VALUES (200, 'b200', 21, 's')", "DELETE FROM items WHERE id = 7")
    rows = run(spark, db, tmp_path, "cycles", updated="changed")
    count = {i: ids(rows).count(i) for i in set(ids(rows))}
    # changed and new rows, and the ties of the old watermark (9: ids 90 to 99), once more; nothing else
    assert {i for i, n in count.items() if n == 2} == {5, 50, *range(90, 100)} and count[200] == 1
    assert [r.kind for r in rows].count("complete") == 1
    db[1].write_text("1")  # the next hour: a full cycle, by which 7 is missed
    whole = run(spark, db, tmp_path, "cycles", updated="changed")
    last = [r for r in whole if r.cycle == 1]
    assert ids(last) == [i for i in (*range(100), 200) if i != 7] and [r.kind for r in last].count("complete") == 1
    known = spark.createDataFrame([(str(i),) for i in (*range(100), 200)], "key string")
    seen = spark.createDataFrame([(r.row_id,) for r in last if r.kind == "row"], "key string")
    assert [r.key for r in maintain.sweep(known, seen, True).collect()] == ["7"]


def test_rows_behind_the_boundary_wait(spark, db, tmp_path):
    """What comes after a batch's end was fixed is the next batch's."""
    path, _ = db
    reader = tables._Reader({"table": "items", "key": "id", "updated": "changed", "size": "30"}, lambda: sqlite3.connect(path), "?", lambda: 0.0)
    start, end = reader.initialOffset(), reader.latestOffset()
    change(db, "INSERT INTO items VALUES (500, 'late', 99, 's')")
    full = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert sorted(int(r[2]) for r in full if r[0] == "row") == list(range(100))
    after = reader.latestOffset()
    change(db, "INSERT INTO items VALUES (501, 'later', 99, 's')")  # a tie of the boundary with a larger key
    more = [int(r[2]) for p in reader.partitions(end, after) for r in reader.read(p)]
    assert sorted(more) == [*range(90, 100), 500]
    last = [int(r[2]) for p in reader.partitions(after, reader.latestOffset()) for r in reader.read(p)]
    assert last == [500, 501]


def test_without_watermark_and_empty(spark, db, tmp_path):
    rows = run(spark, db, tmp_path, "plain")
    assert ids(rows) == list(range(100))
    change(db, "DELETE FROM items")
    db[1].write_text("2")
    rows = [r for r in run(spark, db, tmp_path, "plain") if r.cycle == 2]
    assert [r.kind for r in rows] == ["complete"]
    for bad in ({"table": "items; DROP TABLE items"}, {"size": "0"}):
        with pytest.raises(ValueError):
            tables._Reader({"table": "items", "key": "id", **bad}, None, "?", None)
