"""The queue of changed paths as one stateful query: debounce, coalescing, versioned acknowledgement and overflow.

State is by root and lives with the query's checkpoint, so an event is in it from the batch that read it on, whatever fails
afterwards. Each path has one entry: whether it was a folder, how many events came (the version), when the first came and when it is due: a
quiet while after the last event, but no later than a cap after the first. Timers hand due entries on; an entry stays until its version is
acknowledged, and an event in between makes a new version that is handed on again. A root with more entries than
allowed is emptied and handed on once as ``reconcile``: its folder is to be listed in full.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnfold.streaming.events import CAP_US, QUIET_US

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "root string, kind string, path string, is_directory boolean, version long"
#: Timers are set on a grid of so many milliseconds, so that many entries share one.
GRID_MS = 250


def entry_after(entry: tuple | None, is_directory: bool, now_ms: int, quiet_ms: int, cap_ms: int) -> tuple:
    """(is_directory, version, first, due, version handed on) after one more event."""
    known, version, first, _, told = entry or (False, 0, now_ms, 0, 0)
    return known or is_directory, version + 1, first, min(now_ms + quiet_ms, first + cap_ms), told


class _Queue(StatefulProcessor):
    def __init__(self, quiet_ms: int, cap_ms: int, most: int):
        self.quiet, self.cap, self.most = quiet_ms, cap_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "path string", "is_directory boolean, version long, first long, due long, told long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n = self.count.get()[0] if self.count.exists() else 0
        timers, over = set(), False
        for r in rows:
            at = (r.path,)
            held = tuple(self.entries.getValue(at)) if self.entries.containsKey(at) else None
            if r.version is not None:
                if held and held[1] == r.version:
                    self.entries.removeKey(at)
                    n -= 1
                continue
            if over:
                continue  # the root is listed in full: that finds this change, too
            new = entry_after(held, bool(r.is_directory), now, self.quiet, self.cap)
            n += held is None
            if n > self.most:
                over = True
                self.entries.clear()
                n = 0
                continue
            self.entries.updateValue(at, new)
            timers.add(-(-new[3] // GRID_MS) * GRID_MS)
        self.count.update((n,))
        for t in timers:
            self.handle.registerTimer(max(t, now + 1))
        if over:
            yield Row(root=key[0], kind="reconcile", path=None, is_directory=True, version=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = [(p[0], tuple(e)) for p, e in self.entries.iterator() if e[4] < e[1] and e[3] <= upto]
        for path, (is_directory, version, first, at, _) in sorted(due):
            self.entries.updateValue((path,), (is_directory, version, first, at, version))
            yield Row(root=key[0], kind="changed", path=path, is_directory=is_directory, version=version)

    def close(self) -> None:
        """State is the store's."""


def event_queue(events: DataFrame, acknowledged: DataFrame, quiet_us: int = QUIET_US, cap_us: int = CAP_US, most: int = 10_000) -> DataFrame:
    """``root, kind, path, is_directory, version`` of what is due: kind ``changed`` (a path) or ``reconcile`` (a root).

    Streams: ``events`` (root, path, is_directory) and ``acknowledged`` (root, path, version). ``most`` entries a root bound the state.
    Events without a root or path are no events.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    if not 0 < quiet_us <= cap_us or most < 1:
        raise ValueError("a quiet time up to the cap, and one entry at least")
    both = events.select("root", "path", F.col("is_directory").cast("boolean").alias("is_directory"), F.lit(None).cast("long").alias("version"))
    both = both.unionByName(acknowledged.select("root", "path", F.lit(None).cast("boolean").alias("is_directory"), F.col("version").cast("long").alias("version")).where("version is not null"))
    rows = both.where("root is not null and path is not null")
    return rows.groupBy("root").transformWithState(_Queue(quiet_us // 1000, cap_us // 1000, most), OUTPUT, "append", "processingTime")


def replayed(events: Iterable[tuple[str, bool, int]], quiet_ms: int, cap_ms: int) -> list[tuple[str, int, int]]:
    """(path, version, due) of each version handed on, for events (path, is_directory, at) of one root without acknowledgement: what the query does, event by event."""
    held: dict[str, tuple] = {}
    out = []
    for path, is_directory, at in events:
        for p, e in sorted(held.items()):
            if e[4] < e[1] and e[3] <= at:
                out.append((p, e[1], e[3]))
                held[p] = (*e[:4], e[1])
        held[path] = entry_after(held.get(path), is_directory, at, quiet_ms, cap_ms)
    return out + [(p, e[1], e[3]) for p, e in sorted(held.items()) if e[4] < e[1]]
