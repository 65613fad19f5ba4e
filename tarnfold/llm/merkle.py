"""Merkle manifest of a dataset: a hash tree over its rows, with a proof for each row.

Every row is a leaf, H (lowercase hex SHA-256 of its inputs concatenated, digests as hex text) of its columns, each
``-`` if null and else its UTF-8 byte count, ``:`` and its value. Leaves of one group ascend by key; as long as a group
has several nodes, each run of 8 neighbours (the last run may be shorter, even one node) becomes their H. The subroots of
the groups, ordered by group (null first, bytewise), become the root in the same way.

All of it is SQL: leaves are numbered within their group and gathered in ordered arrays of ``8 ** 3`` (a block). Inside a
block, ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse three levels; the blocks' roots are the next nodes,
and so on until each group has one. On the way down every block hands its own path to its members, so that a row's
siblings are its run-mates in the block followed by those of the block.

Scale: a row is shuffled twice, as its key and digests and never with its text. Numbers come from a sort by range (group,
key, leaf, place in the scan) and a count a partition and group, so a group or key of any share is cut like any other. A block is
512 nodes whatever the table's size, and each round leaves a 512th of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, partitions, written

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """H of the columns, each length-prefixed, so that no two rows share an encoding."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(F.concat(*parts))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) written in ``order`` within their group, with ``at`` (from 0, gapless) and ``total`` of the group."""
    ranged = rows.withColumn("__scan", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), "grp", *order, "__scan")
    held = written(ranged.sortWithinPartitions("grp", *order, "__scan").drop("__scan").withColumn("__id", F.monotonically_increasing_id()), "merkle-rows", "zstd")
    part = F.shiftright("__id", 33)
    counts = held.groupBy("grp", part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    ahead = Window.partitionBy("grp").orderBy("__part")
    whole = Window.partitionBy("grp")
    counts = counts.select("grp", "__part", (F.sum("__n").over(ahead) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("total"))
    out = held.withColumn("__part", part).join(counts, ["grp", "__part"]).withColumn("at", F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")
    out._tarnfold_path = held._tarnfold_path
    return out


def _levels(nodes: Column, alone: Column) -> Column:
    """The nodes and the levels above them within a block: three, or as many as lead to one node where the block is ``alone``."""

    def above(below: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.size(below) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda r: digest(F.array_join(F.slice(below, r * FAN + 1, FAN), "")))

    def step(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(alone & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(above(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step)


def _siblings(levels: Column, place: Column) -> Column:
    """For the node at ``place`` of a block: what stands before and after it in its run, level by level."""

    def at(level: Column) -> Column:
        power = F.pow(F.lit(float(FAN)), level)
        index = (place / power).cast("int")
        nodes = F.element_at(levels, level.cast("int") + 1)
        start = index - index % FAN
        return F.struct(
            F.array_join(F.slice(nodes, start + 1, index - start), "").alias("before"),
            F.array_join(F.slice(nodes, index + 2, start + FAN - 1 - index), "").alias("after"),
        )

    # the last level is the block's own root, which has no run here
    steps = F.slice(F.sequence(F.lit(0), F.size(levels) - 1), F.lit(1), F.size(levels) - 1)
    return F.transform(steps, at)


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """grp, block, total, held (the ``carried`` columns by place) and levels, from nodes (grp, at, total, node, ...)."""
    row = F.struct("at", "node", *carried)
    held = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block"), "total").agg(F.array_sort(F.collect_list(row)).alias("held"))
    levels = _levels(F.transform("held", lambda x: x["node"]), F.col("total") <= BLOCK)
    return held.select("grp", "block", "total", F.transform("held", lambda x: F.struct(*([x[c].alias(c) for c in carried] or [F.lit(0).alias("none")]))).alias("held"), levels.alias("levels"))


def _tops(blocks: DataFrame) -> DataFrame:
    top = F.element_at(F.element_at("levels", -1), 1)
    return blocks.select("grp", F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), top.alias("node"))


def _climb(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """grp, at, path (to the group's subroot) and subroot of each node; written tables are added to ``made``."""
    if not nodes.where("total > 1").limit(1).count():
        return nodes.select("grp", "at", F.array().cast(PATH).alias("path"), F.col("node").alias("subroot"))
    blocks = written(_blocks(nodes, []), "merkle-blocks", "zstd")
    made.append(blocks)
    return _descend(blocks, _climb(_tops(blocks), made)).select("grp", "at", "path", "subroot")


def _descend(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """The members of each block with their whole path: grp, at, path, subroot, node and what was carried."""
    joined = blocks.join(tops.withColumnRenamed("at", "block"), ["grp", "block"])
    places = F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1)
    members = F.transform(
        places,
        lambda p: F.struct(
            p.alias("place"),
            F.element_at("levels", 1)[p].alias("node"),
            F.concat(_siblings(F.col("levels"), p), F.col("path")).alias("path"),
            F.col("held")[p].alias("held"),
        ),
    )
    out = joined.select("grp", "block", "subroot", F.explode(members).alias("m"))
    return out.select("grp", (F.col("block") * BLOCK + F.col("m.place")).alias("at"), "m.path", "subroot", "m.node", "m.held")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    claimed: dict[str, Column] | None = None,
    doubted: Column | None = None,
) -> DataFrame:
    """One row per input row: key, leaf, subroot, root, path (siblings by level), proof_sha256, folded_root, verified.

    ``claimed`` replaces columns where ``doubted`` holds: the folded root is then that of the claimed row and the manifest's siblings.
    By default rows are claimed as they are. A null is ``-``, an empty text ``0:``, and texts count whole, whatever their length. Null
    groups are a group, null keys come first in theirs, rows of equal key are ordered by their leaf, and equal rows are
    leaves of their own. An empty table gives no rows; columns that are not named are ignored, whatever their names.
    """
    own = leaf([docs[c] for c in columns])
    forged = leaf([(claimed or {}).get(c, docs[c]) for c in columns])
    test = F.coalesce(doubted, F.lit(False)) if doubted is not None else F.lit(bool(claimed))
    grp = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))  # null before all others
    leaves = _numbered(docs.select(grp.alias("grp"), docs[key].alias("k"), own.alias("node"), F.when(test, forged).alias("forged")), ["k", "node"])
    blocks = written(_blocks(leaves, ["k", "forged"]), "merkle-blocks", "zstd")
    made: list[DataFrame] = []
    tops = written(_climb(_tops(blocks), made), "merkle-tops", "zstd")
    subroots = _numbered(tops.where("at = 0").select(F.lit("").alias("grp"), F.col("grp").alias("g"), F.col("subroot").alias("node")), ["g"])
    crown = written(_crown(subroots, made), "merkle-crown", "zstd")
    discard(leaves, subroots, *made)
    whole = tops.join(crown, "grp").select("grp", "at", "subroot", "root", F.concat("path", "rest").alias("path"))
    out = _descend(blocks, whole.withColumnRenamed("subroot", "s").withColumn("subroot", F.struct("s", "root")))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select(
        F.col("held.k").alias(key),
        F.col("node").alias("leaf"),
        F.col("subroot.s").alias("subroot"),
        F.col("subroot.root").alias("root"),
        "path",
        digest(proof).alias("proof_sha256"),
        folded(F.coalesce("held.forged", "node"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crown(subroots: DataFrame, made: list[DataFrame]) -> DataFrame:
    """grp, rest (path from its subroot to the root) and root of each group."""
    up = _climb(subroots.select("grp", "at", "total", "node"), made)
    return subroots.select("g", "at").join(up, "at").select(F.col("g").alias("grp"), F.col("path").alias("rest"), F.col("subroot").alias("root"))
