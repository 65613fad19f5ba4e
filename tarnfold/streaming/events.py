"""Change events: debounce with a cap, coalescing, classification, trailing throughput."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUIET_US, CAP_US = 500_000, 3_000_000
# Reason bits of the change journal's records.
REASON_DELETE, REASON_RENAME_OLD = 0x200, 0x1000
REASON_CREATE, REASON_RENAME_NEW, REASON_HARD_LINK, REASON_REPARSE = 0x100, 0x2000, 0x10000, 0x100000
REASON_DATA = 0x1 | 0x2 | 0x4 | 0x10 | 0x20 | 0x40


def settle(times: Iterable[int], quiet: int = QUIET_US, cap: int = CAP_US) -> Iterator[tuple[int, int, int]]:
    """(first, emitted, events) of each burst of ascending times: it ends after a quiet gap or at the cap."""
    first = last = None
    n = 0
    for t in times:
        if first is not None and t >= min(last + quiet, first + cap):
            yield first, min(last + quiet, first + cap), n
            first, n = None, 0
        if first is None:
            first = t
        last = t
        n += 1
    if first is not None:
        yield first, min(last + quiet, first + cap), n


def debounce(events: DataFrame, path: str = "path", at: str = "at_us", quiet: int = QUIET_US, cap: int = CAP_US) -> DataFrame:
    """``path, first_us, emitted_us, events`` of all bursts; ``at`` is in microseconds.

    Events are dealt by path, sorted, and streamed: a burst's state is three numbers, so one path may
    hold any number of events.
    """
    rows = events.select(F.col(path).cast("string").alias("path"), F.col(at).cast("long").alias("at"))
    rows = rows.repartition("path").sortWithinPartitions("path", "at")

    def run(batches):
        def bursts():
            current, first, last, n = None, None, None, 0
            for batch in batches:
                for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if first is not None and (p != current or t >= min(last + quiet, first + cap)):
                        yield current, first, min(last + quiet, first + cap), n
                        first, n = None, 0
                    if first is None:
                        first = t
                    current, last, n = p, t, n + 1
            if first is not None:
                yield current, first, min(last + quiet, first + cap), n

        held = []
        for b in bursts():
            held.append(b)
            if len(held) >= 8192:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return rows.mapInArrow(run, "path string, first_us long, emitted_us long, events long")


def _batch(rows):
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["path", "first_us", "emitted_us", "events"])


def debounce_stream(events: DataFrame, path: str = "path", at: str = "at", quiet: int = QUIET_US, cap: int = CAP_US) -> DataFrame:
    """The same on a stream with a watermark on ``at`` (a timestamp): bursts leave when event time passes them."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        out = []
        first, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            out.append((key[0], first, min(last + quiet, first + cap), n))
            state.remove()
        else:
            times = sorted(t for f in frames for t in f["at_us"].tolist())
            for t in times:
                if first is not None and t >= min(last + quiet, first + cap):
                    out.append((key[0], first, min(last + quiet, first + cap), n))
                    first, n = None, 0
                if first is None:
                    first = t
                last, n = t, n + 1
            state.update((first, last, n))
            due = min(last + quiet, first + cap) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "first_us", "emitted_us", "events"])

    rows = events.select(F.col(path).alias("path"), F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    return rows.groupBy("path").applyInPandasWithState(run, "path string, first_us long, emitted_us long, events long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def coalesce_events(events: DataFrame, path: str = "path", at: str = "at") -> DataFrame:
    """One row a path: whether any event was of a folder, how many there were, the last moment."""
    return events.groupBy(path).agg(F.max("is_directory").alias("is_directory"), F.count("*").alias("version"), F.max(at).alias("last_at"))


def acknowledged(queue: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What stays queued: a path goes only if its version is still the one that was handled."""
    return queue.join(done.select(key, "version"), [key, "version"], "left_anti")


def overflowed(queue: DataFrame, most: int = 10_000) -> bool:
    """Whether the queue is so long that a full scan takes its place."""
    return queue.limit(most + 1).count() > most


def classify(reason: Column) -> Column:
    """delete, reconcile (structure changed in a way that needs a look) or upsert, or null for other bits."""

    def has(bits):
        return reason.bitwiseAND(F.lit(bits)) != 0

    return (
        F.when(has(REASON_DELETE | REASON_RENAME_OLD), "delete")
        .when(has(REASON_HARD_LINK | REASON_REPARSE), "reconcile")
        .when(has(REASON_CREATE | REASON_RENAME_NEW | REASON_DATA), "upsert")
    )


def throughput(events: DataFrame, second: Column, seconds: int = 60) -> DataFrame:
    """``second, n, trailing``: events in the second and in the last ``seconds`` of it."""
    each = events.groupBy(second.alias("second")).agg(F.count("*").alias("n"))
    # dealt by stretches of time with one stretch of overlap, so that no task gets all seconds
    stretch = 64 * seconds
    part = F.floor(F.col("second") / stretch)
    dealt = each.withColumn("part", F.explode(F.array(part, F.floor((F.col("second") + seconds - 1) / stretch)))).distinct()
    window = Window.partitionBy("part").orderBy("second").rangeBetween(-(seconds - 1), 0)
    return dealt.withColumn("trailing", F.sum("n").over(window)).where(F.col("part") == part).select("second", "n", "trailing")
