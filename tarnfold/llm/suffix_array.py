"""Corpus-wide suffix sorting by the difference-cover algorithm, every step a distributed plan.

The suffixes at two of three positions of every text are named by their triples (a distributed sort of the distinct triples),
the names are sorted by recursion on the reduced texts, the other suffixes are ranked by a symbol and the rank behind it, and
both are merged by counting, for each suffix of one kind, the smaller ones of the other.

Scale: no step gathers a text's or a name's rows; the driver sees a row count a partition. A level
holds a row a symbol and moves it several times over, tens of bytes each time. ``suffix_dedup`` therefore
deals the suffixes first and sorts inside deals; the README has the measured cost of this sort beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written


def smaller(rows: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """``keys, below, own``: for each distinct key how many rows with ``counted`` have a smaller key, and how many have this one."""
    each = rows.groupBy(*keys).agg(F.count_if(F.col(counted)).alias("own")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    each = written(each.withColumn("part", F.spark_partition_id()), "keys")
    totals = {r["part"]: r["n"] for r in each.groupBy("part").agg(F.sum("own").alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(totals):
        before[part] = total
        total += totals[part]
    start = each.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    upto = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("own").over(upto), F.lit(0)) + F.col("before")
    return each.join(F.broadcast(start), "part").select(*keys, run.alias("below"), "own")  # a row a partition


def _ranked(symbols: DataFrame, depth: int) -> DataFrame:
    """``d, i, rank`` of symbols (d, i, c; c from 1): how many suffixes are smaller, right over ``depth`` symbols at least."""
    ahead = Window.partitionBy("d").orderBy("i")
    triple = symbols.select("d", "i", "c", F.lead("c", 1, 0).over(ahead).alias("c1"), F.lead("c", 2, 0).over(ahead).alias("c2"))
    triple = written(triple, "triples")
    sample = triple.where("i % 3 != 0")
    names = smaller(sample.withColumn("all", F.lit(True)), ["c", "c1", "c2"], "all")
    named = written(sample.join(names, ["c", "c1", "c2"]).select("d", "i", (F.col("below") + 1).alias("rank"), "own"), "named")
    if depth > 3 and not named.where("own > 1").isEmpty():
        # the triples at one of three places of a text are a text of their own
        reduced = written(named.select((F.col("d") * 2 + F.col("i") % 3 - 1).alias("d"), F.floor(F.col("i") / 3).alias("i"), F.col("rank").alias("c")), "reduced")
        order = _ranked(reduced, -(-depth // 3))
        back = order.select(F.floor(F.col("d") / 2).alias("d"), (F.col("i") * 3 + 1 + F.pmod("d", F.lit(2))).alias("i"), (F.col("rank") + 1).alias("rank"))
        discard(named, reduced)
        named = back
    full = triple.join(named.select("d", "i", "rank"), ["d", "i"], "left")
    full = full.withColumn("r1", F.coalesce(F.lead("rank", 1).over(ahead), F.lit(0))).withColumn("r2", F.coalesce(F.lead("rank", 2).over(ahead), F.lit(0)))
    full = written(full.withColumn("kind", F.col("i") % 3), "full")
    zeros, others = full.where("kind = 0"), full.where("kind != 0")
    real = smaller(others.withColumn("all", F.lit(True)), ["rank"], "all").select("rank", F.col("below").alias("among"))
    zero = F.col("kind") == 0
    pair = smaller(full.where("kind != 2").withColumn("zero", zero), ["c", "r1"], "zero").select("c", "r1", F.col("below").alias("zeros_1"))
    ones_below = smaller(full.where("kind != 2").withColumn("one", ~zero), ["c", "r1"], "one").select("c", "r1", F.col("below").alias("ones"))
    key2 = ["c", "c1", "r2"]
    zeros_2 = smaller(full.where("kind != 1").withColumn("zero", zero), key2, "zero").select(*key2, F.col("below").alias("zeros_2"))
    twos_below = smaller(full.where("kind != 1").withColumn("two", ~zero), key2, "two").select(*key2, F.col("below").alias("twos"))
    z = zeros.join(pair, ["c", "r1"]).join(ones_below, ["c", "r1"]).join(twos_below, key2).select("d", "i", (F.col("zeros_1") + F.col("ones") + F.col("twos")).alias("rank"))
    one = others.where("kind = 1").join(pair, ["c", "r1"]).join(real, "rank").select("d", "i", (F.col("among") + F.col("zeros_1")).alias("rank"))
    two = others.where("kind = 2").join(zeros_2, key2).join(real, "rank").select("d", "i", (F.col("among") + F.col("zeros_2")).alias("rank"))
    out = written(z.unionByName(one).unionByName(two), "ranks")
    discard(triple, named, full)
    return out


def suffix_ranks(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 200) -> DataFrame:
    """``key, start, rank`` of every suffix of every text (bytes; null: none): how many suffixes of the corpus are smaller.

    Suffixes that agree over ``depth`` bytes may share a rank. Suffixes end with their text. Keys must be unique, not
    null and of at most 48 bits; empty texts and an empty table give no rows.
    """

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(0, len(t), 100_000):
                    part = np.frombuffer(t[at : at + 100_000], np.uint8).astype(np.int64) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["d", "i", "c"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("d"), F.col(text).cast("string").cast("binary").alias("t"))
    symbols = rows.mapInArrow(run, "d long, i long, c long")
    return _ranked(symbols, depth).select(F.col("d").alias(key), F.col("i").alias("start"), "rank")
