"""Best-fit packing by a linear grouping scheme, planned on the histogram of lengths.

A document is its ids and an end id; only one longer than a sequence is cut, into pieces of a whole sequence and a last
one. Pieces of equal length can stand for each other, so the plan needs no more than how many pieces there are of
each length (as many numbers as a sequence has tokens, however large the corpus):

1. lengths above ``small`` are put in groups of equal cardinality and rounded up to the longest of their group;
2. configurations of those few sizes that fit a sequence are chosen by the linear programme of fewest sequences (column
   generation: a knapsack over the groups' prices finds the next configuration), and used as often as its rounded-down solution says;
3. the groups' actual documents take the places of the rounded sizes;
4. what the rounding left over and then the small documents go, longest first, where they fit best.

The plan is a list of runs: so many pieces of one length, from a rank among those of its length, go to consecutive sequences
at one offset. Its size depends on the sequence length alone, so sending it to every task is safe. A piece learns its
rank from its task's count and the counts of the tasks before it; ids are never shuffled where those counts are few, and never sorted.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .word_ids import word_ids

#: Counts by task and length that are sent to all tasks (32 bytes each); more of them are joined by a shuffle.
MOST_COUNTS = 200_000
#: A configuration worth less than this beyond its sequence is not looked for.
ENOUGH = 2e-3


@dataclass
class Plan:
    """``runs``: (length, first rank, count, first sequence, offset, pieces a sequence)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    _ranks: dict[int, int] = field(default_factory=dict)
    _open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by gap: (first sequence, count)

    def _place(self, length: int, count: int, first: int, offset: int, per: int = 1) -> None:
        if not count:
            return
        rank = self._ranks.get(length, 0)
        self.runs.append((length, rank, count, first, offset, per))
        self._ranks[length] = rank + count

    def _leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self._open.setdefault(gap, []).append((first, count))

    def configured(self, slots: list[list[list[int]]], count: int) -> None:
        """``count`` sequences of one configuration; each slot is a group's waiting [length, count] segments."""
        alike = [(self.sequences, count, 0)]
        self.sequences += count
        for waiting in slots:
            after = []
            for first, n, used in alike:
                while n:
                    length, there = waiting[-1]
                    take = min(n, there)
                    self._place(length, take, first, used)
                    after.append((first, take, used + length))
                    first, n, waiting[-1][1] = first + take, n - take, there - take
                    if take == there:
                        waiting.pop()
            alike = after
        for first, n, used in alike:
            self._leave(self.capacity - used, first, n)

    def best_fit(self, length: int, count: int) -> None:
        """Each piece to the fullest sequence that holds it; pieces of one length at once, which is the same as one by one."""
        while count:
            gap = min((g for g in self._open if g >= length), default=None)
            if gap is None:
                per = self.capacity // length
                new = -(-count // per)
                self._leave(self.capacity, self.sequences, new)
                self.sequences += new
                continue
            first, there = self._open[gap].pop()
            if not self._open[gap]:
                del self._open[gap]
            per = gap // length
            whole = min(there, count // per)
            if whole:
                self._place(length, whole * per, first, self.capacity - gap, per)
                self._leave(gap - per * length, first, whole)
                count -= whole * per
            elif count:
                self._place(length, count, first, self.capacity - gap, count)
                self._leave(gap - count * length, first, 1)
                whole, count = 1, 0
            self._leave(gap, first + whole, there - whole)


def grouped_sizes(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, segments [length, count] ascending) of equal-cardinality groups of the lengths above ``small``, longest first.

    No more different lengths than groups are groups of their own, and nothing is rounded.
    """
    own = [n for n in range(len(counts) - 1, small, -1) if counts[n]]
    if len(own) <= groups:
        return [(n, [[n, int(counts[n])]]) for n in own]
    left = int(counts[small + 1 :].sum())
    out: list[tuple[int, list[list[int]]]] = []
    each, room = -(-left // groups) if left else 0, 0
    for length in range(len(counts) - 1, small, -1):
        n = int(counts[length])
        while n:
            if not room:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                room = each
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    return [(size, segments[::-1]) for size, segments in out]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (how many of each size) and how often each is used: the linear programme of fewest sequences."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = np.ones(k) @ inverse
        column = _knapsack(sizes, prices, capacity)
        if prices @ column <= 1 + ENOUGH:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        used = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis.round().astype(np.int64), used


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes that fits; one more piece a layer, as a sequence holds few large ones."""
    best = [np.zeros(capacity + 1)]
    chosen: list[np.ndarray] = []
    useful = [i for i in range(len(sizes)) if prices[i] > 1e-12]
    for _ in range(capacity // int(sizes.min())):
        value, choice = best[-1].copy(), np.full(capacity + 1, -1)
        for i in useful:
            s = int(sizes[i])
            other = best[-1][: capacity + 1 - s] + prices[i]
            better = other > value[s:] + 1e-12
            value[s:][better] = other[better]
            choice[s:][better] = i
        if (choice < 0).all():
            break
        best.append(value)
        chosen.append(choice)
    column, room = np.zeros(len(sizes)), capacity
    for choice in reversed(chosen):
        if (i := int(choice[room])) >= 0:
            column[i] += 1
            room -= int(sizes[i])
    return column


def plan(counts: np.ndarray, groups: int = 256, small: int | None = None) -> Plan:
    """The plan for ``counts[n]`` pieces of each length n up to the sequence length ``len(counts) - 1``.

    By default what is longer than three tenths of a sequence is large.
    """
    capacity = len(counts) - 1
    small = 3 * capacity // 10 if small is None else small
    out, rest = Plan(capacity), counts.astype(np.int64).copy()
    out._place(capacity, int(rest[capacity]), 0, 0)
    out.sequences, rest[capacity] = int(rest[capacity]), 0
    held = grouped_sizes(rest, small, groups)
    if held:
        sizes = np.array([size for size, _ in held])
        demand = np.array([sum(n for _, n in segments) for _, segments in held], float)
        columns, used = configurations(sizes, demand, capacity)
        for j in np.argsort(-(sizes @ columns), kind="stable"):
            times = int(used[j] + 1e-6)
            waiting = [held[i][1] for i in range(len(held)) for _ in range(columns[i, j])]
            if times:
                out.configured(waiting, times)
    left = dict(enumerate(rest[: small + 1].tolist()))
    for _, segments in held:
        for length, n in segments:
            left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        if left[length]:
            out.best_fit(length, left[length])
    return out


SCHEMA = "doc_id long, piece int, start long, length long, ids binary, task long, nth long"


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents with their ids, the task that cut them and their number among its pieces of that length."""

    def run(batches):
        encoder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                columns: list[list] = [[] for _ in range(7)]
                for k, ids in zip(keys[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        n = len(part) // 4
                        for c, v in zip(columns, (k, piece, start, n, part, task, int(seen[n])), strict=True):
                            c.append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("nth", pa.int64())])


def pack_best_fit(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = 2048, groups: int = 256, small: int | None = None, most_counts: int = MOST_COUNTS
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document up to ``capacity`` tokens (its end id counts) is whole; of a longer one all pieces but the last are whole sequences. A null
    or empty text is its end id alone; very long texts are cut like any other, after they were encoded whole. Null and repeated
    keys and repeated rows are documents of their own, and pieces of equal length are interchangeable, whatever share of all
    they are. An empty table gives no rows; other columns are ignored. Sequences are numbered from 0.
    """
    held = written(pieces(docs, tokenizer, key, text, end_id, capacity), "pieces", "zstd")
    tasks = written(held.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        counts[r["length"]] = r["n"]
    made = plan(counts, groups, small)
    before = Window.partitionBy("length").orderBy("task")
    base = tasks.select("task", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    if tasks.count() <= most_counts:
        base = F.broadcast(base)
    spark = docs.sparkSession
    runs = spark.createDataFrame(made.runs, "length long, first long, count long, sequence long, offset long, per long")
    runs = runs.groupBy("length").agg(F.collect_list(F.struct("first", "count", "sequence", "offset", "per")).alias("runs"))
    ranked = held.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    found = ranked.join(F.broadcast(runs), "length")  # bounded by the sequence length
    run = F.filter("runs", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["first"] + r["count"]))[0]
    found = found.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.first"))
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("run.sequence") + F.floor(F.col("nth") / F.col("run.per"))).alias("sequence_id"),
        (F.col("run.offset") + F.col("nth") % F.col("run.per") * F.col("length")).alias("offset"),
    )
