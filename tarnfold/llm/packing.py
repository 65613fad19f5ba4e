"""Hierarchical packing of documents into several context sizes.

A document's tokens are its ids and an end id. Full windows of the largest tier are cut off first; the
remainder is routed to the smallest tier that holds it. Each tier is packed in turn, largest first: a
document opens a window, the gap takes the largest documents of shorter tiers that fit, and what is
left of the gap is closed with a piece cut from a shorter (or the same) tier. So every window is exactly
full; only the last one of a task may be short. Windows of one tier are then dealt to step groups of
equal token count so that the groups' attention costs (sum of squared piece lengths) are level.

Scale: one pass, no shuffle; a task holds ``buffer_tokens`` tokens at a time.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .word_ids import word_ids

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)


class _Window:
    __slots__ = ("pieces", "size", "used")

    def __init__(self, size):
        self.size, self.used, self.pieces = size, 0, []

    def add(self, doc, start, length):
        self.pieces.append((doc, start, length, self.used))
        self.used += length


def pack(lengths: list[int], tiers: tuple[int, ...], closing: bool = True) -> tuple[list[_Window], list[tuple[int, int, int]]]:
    """Windows for documents of these lengths, and what is left over as (document, start, length).

    With ``closing`` nothing is left over: the last windows may be short.
    """
    tiers = tuple(sorted(tiers, reverse=True))
    top = tiers[0]
    windows: list[_Window] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def tier_of(n: int) -> int:
        return min(t for t in tiers if n <= t)

    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            w = _Window(top)
            w.add(doc, at, top)
            windows.append(w)
            at += top
        if n > at:
            pools[tier_of(n - at)].append((n - at, doc, at))
    for p in pools.values():
        p.sort()

    def fitting(gap: int, below: int):
        """The largest document of a tier under ``below`` that fits the gap."""
        for t in tiers:
            if t < below and pools[t] and pools[t][0][0] <= gap:
                return pools[t].pop(bisect_right(pools[t], gap, key=lambda x: x[0]) - 1)
        return None

    left: list[tuple[int, int, int]] = []
    for t in tiers:
        own = pools[t]
        while own:
            n, doc, at = own.pop()
            w = _Window(t)
            w.add(doc, at, n)
            while gap := t - w.used:
                if x := fitting(gap, t if t > tiers[-1] else t + 1):
                    w.add(x[1], x[2], x[0])
                    continue
                source = next((pools[s] for s in reversed(tiers) if s <= t and pools[s]), None)
                if source is None:
                    break
                n, doc, at = source.pop()  # longer than the gap: cut, and the rest goes back
                w.add(doc, at, gap)
                insort(pools[tier_of(n - gap)], (n - gap, doc, at + gap))
            if w.used == t or closing:
                windows.append(w)
            else:
                left += [(d, s, n) for d, s, n, _ in w.pieces]
    return windows, left


def step_groups(windows: list[_Window], step_tokens: int, first: int) -> tuple[list[int], int]:
    """A group number for each window: groups of one tier, equal in tokens, level in attention cost."""
    out = [0] * len(windows)
    for tier in sorted({w.size for w in windows}, reverse=True):
        own = sorted((i for i, w in enumerate(windows) if w.size == tier), key=lambda i: (-sum(n * n for _, _, n, _ in windows[i].pieces), i))
        groups = max(1, -(-len(own) * tier // step_tokens))
        for k, i in enumerate(own):
            turn, at = divmod(k, groups)
            out[i] = first + (at if turn % 2 == 0 else groups - 1 - at)
        first += groups
    return out, first


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = (2048, 1024, 512, 256),
    step_tokens: int = 16384,
    buffer_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with its ids.

    ``ids`` are little-endian unsigned 32-bit. ``offset`` runs gapless from 0 within a sequence;
    ``sequence_id`` is the task's number shifted left by 33 plus a count, the same whenever the task is
    run again. A null or empty text has the end id alone. Null keys, repeated rows and equal lengths
    keep a piece each (ties by input order); very long texts are encoded whole, then cut; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        encoder = word_ids(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        task = (TaskContext.get() and TaskContext.get().partitionId() or 0) << 33
        sequence, group = 0, 0
        keys: list = []
        bodies: list[bytes] = []
        starts: list[int] = []
        totals: list[int] = []

        def flush(closing: bool):
            nonlocal sequence, group, keys, bodies, starts, totals
            windows, left = pack([len(b) // 4 for b in bodies], tiers, closing)
            groups, group = step_groups(windows, step_tokens, group)
            columns: list[list] = [[] for _ in range(9)]
            for w, g in zip(windows, groups, strict=True):
                for doc, at, n, offset in w.pieces:
                    row = (keys[doc], starts[doc] + at, n, totals[doc], task + sequence, offset, w.size, task + g, bodies[doc][4 * at : 4 * (at + n)])
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                sequence += 1
            left.sort()
            keys, bodies, starts, totals = (
                [keys[d] for d, _, _ in left],
                [bodies[d][4 * s : 4 * (s + n)] for d, s, n in left],
                [starts[d] + s for d, s, _ in left],
                [totals[d] for d, _, _ in left],
            )
            return columns

        held = 0
        for batch in batches:
            doc_keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for k, ids in zip(doc_keys[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    ids += end
                    keys.append(k)
                    bodies.append(ids)
                    starts.append(0)
                    totals.append(len(ids) // 4)
                    held += len(ids) // 4
                if held >= buffer_tokens:
                    yield _batch(flush(False))
                    held = sum(map(len, bodies)) // 4
        if bodies:
            yield _batch(flush(True))

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int32()),
        ("step_group", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
