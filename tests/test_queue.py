"""The event queue as a running query: nothing is lost or repeated when it is killed and started again."""

import json
import time

import pytest

from tarnfold.streaming import queue
from tarnfold.streaming.queue import STORE, event_queue


@pytest.fixture
def stated(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """Files of events and acknowledgements, the query over them, and what it handed on."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options, self.n = spark, base, options, 0
        for d in ("events", "acks"):
            (base / d).mkdir()
        self.query = None

    def put(self, folder, rows):
        self.n += 1
        part = self.base / f"{self.n}.tmp"
        part.write_text("\n".join(map(json.dumps, rows)))
        part.rename(self.base / folder / f"{self.n:04}.json")

    def event(self, *paths, root="r", directory=False):
        self.put("events", [{"root": root, "path": p, "is_directory": directory} for p in paths])

    def ack(self, path, version, root="r"):
        self.put("acks", [{"root": root, "path": path, "version": version}])

    def start(self):
        events = self.spark.readStream.schema("root string, path string, is_directory boolean").json(str(self.base / "events"))
        acks = self.spark.readStream.schema("root string, path string, version long").json(str(self.base / "acks"))
        out = event_queue(events, acks, **self.options)
        self.query = out.writeStream.format("parquet").option("path", str(self.base / "out")).option("checkpointLocation", str(self.base / "check")).trigger(processingTime="200 milliseconds").start()

    def stop(self):
        self.query.stop()

    def rows(self):
        try:
            return sorted(((r.kind, r.path, r.version) for r in self.spark.read.schema(queue.OUTPUT).parquet(str(self.base / "out")).collect()), key=str)
        except Exception:
            return []

    def wait(self, want, seconds=60):
        until = time.time() + seconds
        while time.time() < until and self.rows() != want:
            assert self.query is None or self.query.exception() is None
            time.sleep(0.3)
        assert self.rows() == want


def test_kill_and_restart(stated, tmp_path):
    f = Feed(stated, tmp_path, quiet_us=300_000, cap_us=2_000_000)
    f.event("a", "b", "a")
    f.start()
    told = [("changed", "a", 2), ("changed", "b", 1)]
    f.wait(told)
    f.stop()
    f.event("c")  # while it is down
    f.ack("a", 2)
    f.ack("b", 7)  # another version: b stays
    f.start()
    told = sorted([*told, ("changed", "c", 1)], key=str)
    f.wait(told)
    f.event("a", "b")  # a begins anew, b goes on
    told = sorted([*told, ("changed", "a", 1), ("changed", "b", 2)], key=str)
    f.wait(told)
    f.stop()
    f.start()
    time.sleep(3)
    assert f.rows() == told  # nothing again
    f.stop()


def test_overflow_is_one_reconcile(stated, tmp_path):
    f = Feed(stated, tmp_path, quiet_us=300_000, cap_us=2_000_000, most=5)
    f.event(*[f"p{i}" for i in range(9)])
    f.event("x", root="other")
    f.start()
    f.wait(sorted([("changed", "x", 1), ("reconcile", None, None)], key=str))
    f.event("p1")  # the queue works on
    f.wait(sorted([("changed", "x", 1), ("changed", "p1", 1), ("reconcile", None, None)], key=str))
    f.stop()


def test_entries():
    from tarnfold.streaming.events import settle

    times = [0, 100, 350, 600, 2000, 2300, 2600, 2900, 3200, 9000]
    told = queue.replayed([("p", False, t) for t in times], 500, 1000)
    assert [v for _, v, _ in told] == sorted({v for _, v, _ in told}) and told[-1][1] == len(times)
    first = next(iter(settle([t * 1000 for t in times], 500_000, 1_000_000)))
    assert told[0][2] * 1000 == first[1]
    assert queue.replayed([("a", True, 0), ("b", False, 10)], 500, 1000) == [("a", 1, 500), ("b", 1, 510)]


def test_refusals(spark):
    with pytest.raises(ValueError, match="providerClass"):
        event_queue(spark.range(1), spark.range(1))
