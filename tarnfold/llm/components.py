"""Connected components by alternating large-star and small-star steps.

Edges and labels stay distributed. Each step's result is written to the shared folder, which cuts the
lineage and leaves both sides of every join as plain exchanges, so that adaptive execution can split a
hot node's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` of every id in ``edges`` (columns a, b); component is the smallest id reachable.

    Self-links and repeated links do no harm; rows with a null end are ignored; no edges give no rows.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.where("a is not null and b is not null and a != b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _is_stars(now):
            members, roots = now.select(F.col("u").alias("id"), F.col("v").alias("component")), now.select(F.col("v").alias("id"), F.col("v").alias("component"))
            out = members.unionByName(roots.distinct())
            out._tarnfold_path = now._tarnfold_path  # for ``discard``, when the result is used up
            return out
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = written(step.distinct(), "edges")
        discard(now, least)
        now = after
    raise RuntimeError("components did not settle")


def _is_stars(edges: DataFrame) -> bool:
    """Every id has one link, to an id that has none of its own: one pass over both ends."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    each = ends.groupBy("id").agg(F.sum("up").alias("links"), F.count("*").alias("all"))
    return each.where("links > 1 or links = 1 and all > 1").isEmpty()
