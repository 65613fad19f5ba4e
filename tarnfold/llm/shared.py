"""Helpers that several operators share: written intermediate tables, columns, encoders."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnfold.plans.folders import work_folder


def written(df: DataFrame, tag: str, compression: str = "snappy", partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts the lineage and outlives executors.

    Whoever writes a table discards it when no plan reads it any more; nobody else does.
    """
    path = f"{work_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tarnfold_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_tarnfold_path", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(batches, by: int):
    """(key, rows) of each group of a sorted Arrow stream whose first ``by`` columns are the key, without nulls."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        marks = np.stack([batch.column(k).to_numpy() for k in range(by)])
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(by)):
            yield _group(held, by)
            held = []
        for a, b in zip(edges, edges[1:], strict=False):
            if a:
                yield _group(held, by)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield _group(held, by)


def _group(held: list[pa.Table], by: int) -> tuple[tuple, pa.Table]:
    return tuple(held[0].column(k)[0].as_py() for k in range(by)), pa.concat_tables(held).combine_chunks()


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: Rough bytes of an entry of a dict besides its key and value.
ENTRY = 160
#: Longer keys hardly come again and are not remembered.
LONG = 200


class Memo(dict):
    """A memo in two generations, each bounded by bytes; ``make`` answers what neither knows.

    ``trimmed`` returns the memo to go on with: when the young generation is full, it becomes the old
    one, and what is still in use is copied from it as it is met.
    """

    def __init__(self, make, limit: int = 100_000_000, before: dict | None = None):
        super().__init__()
        self.make, self.limit, self.before, self.held = make, limit, before or {}, 0

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
            self.held += ENTRY + key.__sizeof__() + len(value)
        return value

    def trimmed(self) -> Memo:
        return self if self.held < self.limit else Memo(self.make, self.limit, dict(self))
