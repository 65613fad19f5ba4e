"""Vector storage and encoding: half-precision forms, providers, segments and when to publish."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(vectors: DataFrame, key: str, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """``key, vector`` with the vector as half-precision bytes; others than ``dim`` finite components raise."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                a = np.array(v if v is not None and None not in v else [np.nan], np.float16)
                if dim is not None and len(a) != dim or not np.isfinite(a).all():
                    raise ValueError("a finite vector of the right length is expected")
                out.append(a.astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "vector"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("k"), embedding).mapInArrow(run, f"k {kind}, vector binary").withColumnRenamed("k", key)


def unpacked(rows: DataFrame, key: str, dim: int, vector: str = "vector") -> DataFrame:
    """``key, embedding``; reads half precision and, by its length, single precision."""

    def run(batches):
        for batch in batches:
            out = []
            for b in batch.column(1).to_pylist():
                if len(b) not in (2 * dim, 4 * dim):
                    raise ValueError("a vector of the right length is expected")
                out.append(np.frombuffer(b, "<f2" if len(b) == 2 * dim else "<f4").astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["k", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), vector).mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def hashing_provider(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: hashed words, unit length. It needs no files."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)

    return encode


def encoded(rows: DataFrame, key: str, text: str, provider: Callable[[], Callable[[list[str]], np.ndarray]], model: str, batch_size: int = 64) -> DataFrame:
    """``key, model, embedding``; the provider is built once a task and sees ``batch_size`` texts at a time."""

    def run(batches):
        encode = provider()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                v = encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * part.num_rows), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=["k", "model", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), text).mapInArrow(run, f"k {kind}, model string, embedding array<float>").withColumnRenamed("k", key)


def segments(missing: DataFrame, capacity: int, first: int = 0, key: str = "chunk_id") -> DataFrame:
    """Members of new segments: each row's segment by key ranges of about ``capacity`` rows.

    Rows are dealt by range once; no single task sees them all.
    """
    count = missing.count()
    many = max(1, -(-count // capacity))
    dealt = missing.repartitionByRange(many, key)
    return dealt.withColumn("segment", (F.spark_partition_id() + first).cast("int"))


def should_publish(pending: int, waited: float, drained: bool, most: int = 256, longest: float = 10.0) -> bool:
    return pending > 0 and (pending >= most or waited >= longest or drained)


def still_valid(hits: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Hits whose file is still there with the same identity (files: path, identity, is_link, in_scope)."""
    good = files.where(F.col("in_scope") & ~F.col("is_link")).select(path, "identity")
    return hits.join(good, [path, "identity"], "left_semi")


def authorized_rows(hits: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Database evidence whose table, key column and text columns are still allowed.

    ``hits``: source_id, table, id_column, columns; ``allowlist`` the same, one row a table.
    """
    a = allowlist.select("source_id", "table", "id_column", F.col("columns").alias("__allowed"))
    j = hits.join(F.broadcast(a), ["source_id", "table", "id_column"])  # the configuration's tables, at most 1,000
    return j.where(F.size(F.array_except("columns", "__allowed")) == 0).drop("__allowed")


def short_path_tokens(path: Column) -> Column:
    """Distinct sorted CJK characters and pairs of a path, joined by blanks."""
    from tarnfold.functions.text import CJK, _letters, _pairs

    runs = F.regexp_extract_all(path, F.lit(f"([{CJK}]+)"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(_letters(r), _pairs(r)))))), " ")
