"""Token ids in files of range-asymmetric-numeral-system blocks under one shared frequency table.

Documents are laid out in ascending key order. One frequency table, counted over all of them, serves
every block, so blocks decode alone. Inside a block symbol i belongs to lane i mod lanes; lanes are
64-bit states that share one stream of 32-bit words. A block stores the lanes' states and the word
position at fixed steps (checkpoints, from which a part can be decoded alone) and checksums of the words
and of the ids.

Files: a Parquet folder ``blocks`` with a row per block (ids before it in the whole, blob) and a folder
``table`` with the frequency table, so any store that Spark writes will do. Scale: documents are ranged
by key once; the driver sees one total per task and a count per token of the vocabulary.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, partitions, written
from .word_ids import word_ids

SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"TFRANS1\0"
COUNTS = -1
HEADER = struct.Struct("<8sIIIIIIIIQ")


class Table:
    """Frequencies scaled to 2**SCALE; every counted symbol keeps at least one."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 65536 else np.uint32), freq.astype(np.int64))
        self.check = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.float64)
        seen = counts > 0
        if seen.sum() > 1 << SCALE:
            raise ValueError("more symbols than the table has room for")
        if not seen.any():
            return cls(np.array([1 << SCALE], dtype=np.int64))
        freq = np.where(seen, np.maximum(1, np.floor(counts * ((1 << SCALE) / counts.sum()))), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        over, k = int(freq.sum()) - (1 << SCALE), 0
        while over:  # the largest give or take the difference
            i = order[k % len(order)]
            step = -over if over < 0 else -min(over, max(0, int(freq[i]) // 2 - 1))
            freq[i] += step
            over += step
            k += 1
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = 2048, every: int = 256) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    freq, first = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id outside the frequency table")
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    limit = np.uint64(31 - SCALE + 32)
    scale = np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], first[t * lanes : (t + 1) * lanes]
        x = state[: len(f)]
        out = x >= (f << limit)
        if out.any():
            words.append(x[out].astype(np.uint32))
            x = np.where(out, x >> WORD, x)
        else:
            words.append(np.empty(0, np.uint32))
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + c
        if t % every == 0 and t:
            marks.append((t, state.copy()))
    words.reverse()
    position = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if words else np.zeros(1, int)
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    marks.reverse()
    parts = [struct.pack("<II", t, int(position[t])) + s.astype("<u8").tobytes() for t, s in marks]
    head = HEADER.pack(MAGIC, n, lanes, SCALE, table.check, every, len(marks), zlib.crc32(stream), zlib.crc32(ids.astype("<u4").tobytes()), len(stream))
    return b"".join([head, state.astype("<u8").tobytes(), *parts, stream])


def decode_block(blob: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """All ids of a block, checked; or of one part alone, from its checkpoint to the next."""
    magic, n, lanes, scale, check, every, marks, words_crc, ids_crc, size = HEADER.unpack_from(blob)
    if magic != MAGIC or scale != SCALE or check != table.check:
        raise ValueError("not a block of this table")
    at = HEADER.size
    state = np.frombuffer(blob, "<u8", lanes, at).copy()
    at += 8 * lanes
    points = [(0, 0, state)]
    for _ in range(marks):
        t, p = struct.unpack_from("<II", blob, at)
        points.append((t, p, np.frombuffer(blob, "<u8", lanes, at + 8).copy()))
        at += 8 + 8 * lanes
    stream = blob[at : at + size]
    if len(stream) != size or zlib.crc32(stream) != words_crc:
        raise ValueError("damaged block")
    words = np.frombuffer(stream, "<u4").astype(np.uint64)
    steps = -(-n // lanes)
    t, position, state = points[part or 0]
    until = steps if part is None or part == marks else points[part + 1][0]
    out = np.empty(min(until * lanes, n) - t * lanes, np.uint32)
    mask, scale64, base = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), t * lanes
    for t in range(t, until):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & mask
        s = table.symbol[slot]
        out[t * lanes - base : t * lanes - base + k] = s
        x = table.freq[s] * (x >> scale64) + slot - table.start[s]
        low = x < LOW
        count = np.count_nonzero(low)
        if count:
            x[low] = (x[low] << WORD) | words[position : position + count]
            position += count
        state[:k] = x
    if part is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("checksum of the ids differs")
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, block_tokens: int = 1 << 20) -> None:
    """Encode every text, append ``end_id``, and write all ids under ``path`` in ascending key order.

    Null texts are empty; null keys come first; equal keys follow one another by a hash of their text, equal rows as they lie, and are
    many tasks' where they are many. A very long text is encoded whole and has a block to itself beyond ``block_tokens``.
    An empty table writes no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    # by range of key, text and place in the scan: one key, even of equal rows, may hold any share of all
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc(), F.col("at").asc()]
    rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("at")

    def encode(batches):
        encoder, end, part = word_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        before, seen = 0, np.zeros(0, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                ids = [x + end for x in encoder.encode(texts[at : at + 512])]
                sizes = [len(x) // 4 for x in ids]
                flat = np.frombuffer(b"".join(ids), "<u4")
                cuts = np.cumsum([0, *sizes])
                width = 2 if not len(flat) or flat.max() < 65536 else 4  # bytes an id, told by a leading byte
                raw, head = flat.astype(f"<u{width}").tobytes(), bytes((width,))
                packed = [head + raw[width * a : width * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(before + cuts[:-1]), keys.slice(at, len(ids)), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.binary())],
                    names=["part", "at", "k", "n", "ids", "counts"],
                )
                before += int(cuts[-1])
                seen = _added(seen, np.bincount(flat))
        # the task's counts ride along as a last row, so that no id is read again for them
        (found,) = np.nonzero(seen)
        counts = found.astype("<u4").tobytes() + seen[found].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([COUNTS], pa.int64()), pa.array([None], pa.int64()), pa.array([before], pa.int64()), pa.array([None], pa.binary()), pa.array([counts], pa.binary())], names=["part", "at", "k", "n", "ids", "counts"])

    ids = written(rows.mapInArrow(encode, "part int, at long, k long, n long, ids binary, counts binary"), "rans-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                k = len(x) // 12
                own = np.zeros(int(np.frombuffer(x, "<u4", k)[-1]) + 1 if k else 0, np.int64)
                own[np.frombuffer(x, "<u4", k)] = np.frombuffer(x, "<i8", k, 4 * k)
                total = _added(total, own)
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    tallies = ids.where(F.col("at") == COUNTS)
    counts = tallies.select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        freq[r.id] = r.n
    made = Table.of_counts(freq)
    shared = made.freq.astype("<u4").tobytes()
    spark.createDataFrame([(shared,)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    totals = sorted((r.part, r.n) for r in tallies.select("part", "n").collect())  # a row a task
    before, at = {}, 0
    for p, n in totals:
        before[p] = at
        at += n

    def blocks(batches):
        table = Table(np.frombuffer(shared, "<u4").astype(np.int64))
        keys, sizes, bodies, held, part, start, following = [], [], [], 0, None, 0, 0

        def made_block():
            index = struct.pack("<I", len(keys)) + np.array([k is None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(sizes, "<u4").tobytes()
            blob = index + encode_block(np.concatenate(bodies), table)
            return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([blob], pa.binary())], names=["start", "blob"])

        for batch in batches:
            for p, at, k, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at += before[p]
                if keys and (p != part or at != following or held + n > block_tokens):
                    yield made_block()
                    keys, sizes, bodies, held = [], [], [], 0
                if not keys:
                    part, start = p, at
                keys.append(k)
                sizes.append(n)
                bodies.append(_wide(x))
                held += n
                following = at + n
        if keys:
            yield made_block()

    # a task's file holds its rows in order, however readers split it; so no row moves again
    ids.where(F.col("at") != COUNTS).drop("counts").mapInArrow(blocks, "start long, blob binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(ids)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[: len(b)] += b
    return a


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.uint32)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start, n_tokens, ids`` (unsigned 32-bit)."""
    shared = bytes(spark.read.parquet(f"{path}/table").first()["freq"])

    def decode(batches):
        table = Table(np.frombuffer(shared, "<u4").astype(np.int64))
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (n,) = struct.unpack_from("<I", blob)
                null = np.frombuffer(blob, np.uint8, n, 4).astype(bool)
                keys = np.frombuffer(blob, "<i8", n, 4 + n)
                sizes = np.frombuffer(blob, "<u4", n, 4 + 9 * n).astype(np.int64)
                ids = decode_block(blob[4 + 13 * n :], table).astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                for a in range(0, n, 512):
                    b = min(n, a + 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], mask=null[a:b]), pa.array(start + cuts[a:b]), pa.array(sizes[a:b]), pa.array([ids[4 * cuts[i] : 4 * cuts[i + 1]] for i in range(a, b)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    blocks = spark.read.schema("start long, blob binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")

