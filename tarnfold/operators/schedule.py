"""Scheduling of index work: what is due, in which turn, and what a change of scope takes back.

Queues and catalogues are tables; every function is a plan over them. What reaches the driver is a batch of a stated size.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.operators.evidence import fair_selection
from tarnfold.operators.maintain import minimal_roots
from tarnfold.plans.folders import work_folder

UNFINISHED = ("pending", "budget", "error")


def due_files(queue: DataFrame, documents: DataFrame, now: float, size: int, paused: bool = False, key: str = "doc_id") -> DataFrame:
    """The next ``size`` documents to parse, with their attempts: due queue entries that still have a document.

    ``queue``: key, available_at, attempts, priority. A quarter of the batch is the oldest normal work. A paused indexer takes nothing and
    loses nothing: the queue is not changed.
    """
    due = queue.where(F.col("available_at") <= now).join(documents.select(key), key, "left_semi")
    batch = fair_selection(due, 0 if paused else size, key)
    return batch.join(documents, key)


def due_directories(directories: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """The next directories to list: those of roots that are still discovered, urgent ones first, then in order of arrival.

    ``directories``: path, root, priority, arrived; ``roots``: root, phase, generation.
    """
    open_roots = roots.where("phase = 'discover'").select("root", "generation")
    return directories.join(open_roots, "root").orderBy(F.desc("priority"), "arrived", "path").limit(size)


def round_robin(tables: DataFrame, next_source: int, pages: int, row_budget: int) -> DataFrame:
    """Which pages a tick reads: ``turn, source, table, page, rows``.

    ``tables``: source, position (of the source), table, index (in its source), next_table, page_size, due, remaining. Sources take
    turns from ``next_source`` on, tables of a source from its ``next_table`` on; a tick reads at most
    ``pages`` pages and ``row_budget`` rows of a source, a table's next page only when the others had theirs.
    """
    live = tables.where("due and remaining > 0")
    sources = F.max(F.col("position") + 1).over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = live.withColumn("__sources", sources).withColumn("__tables", F.max(F.col("index") + 1).over(own))
    size = F.least(F.col("page_size"), F.lit(row_budget))
    rounds = F.least(F.ceil(F.col("remaining") / size), F.lit(pages))
    page = live.withColumn("page", F.explode(F.sequence(F.lit(0), rounds.cast("int") - 1)))
    page = page.withColumn("rows", F.least(size, F.col("remaining") - F.col("page") * size).cast("long"))
    place = [F.col("page"), F.pmod(F.col("index") - F.col("next_table"), F.col("__tables"))]
    in_source = Window.partitionBy("source").orderBy(*place)
    page = page.withColumn("__nth", F.row_number().over(in_source))
    page = page.withColumn("__before", F.coalesce(F.sum("rows").over(in_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    page = page.where((F.col("__nth") <= pages) & (F.col("__before") < row_budget))
    page = page.withColumn("rows", F.least(F.col("rows"), F.lit(row_budget) - F.col("__before")))
    source_turn = F.pmod(F.col("position") - F.lit(next_source), F.col("__sources"))
    return page.select(source_turn.cast("int").alias("turn"), "source", "table", "page", "rows", F.col("__nth").alias("nth"))


def control(state: DataFrame, commands: DataFrame) -> DataFrame:
    """``job, status, attempts, cursor`` after commands (job, at, command: pause, resume, cancel), the last one holding.

    Pausing keeps cursor and attempts as they are and is no failure; a cancelled job starts anew when it is resumed.
    """
    last = commands.groupBy("job").agg(F.max_by("command", F.struct("at", "command")).alias("command"), F.max(F.when(F.col("command") == "cancel", F.col("at"))).alias("cancelled"))
    j = state.join(last, "job", "left")
    status = F.when(F.col("command") == "pause", "paused").when(F.col("command") == "cancel", "cancelled").when(F.col("command") == "resume", "running").otherwise(F.col("status"))
    return j.select("job", status.alias("status"), F.when(F.col("cancelled").isNull(), F.col("attempts")).otherwise(0).alias("attempts"), F.when(F.col("cancelled").isNull(), F.col("cursor")).alias("cursor"))


def publish_results(results: DataFrame, present: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a batch of parsed files may publish: ``key, status, reason, publish``.

    ``results``: key, path, size, mtime_ns, identity (as they were read), status, reason. ``present``: path and the same three, now.
    A file that changed while it was read goes back to the queue; a result whose document has another identity by now is dropped.
    """
    now = present.select("path", *[F.col(c).alias(f"now_{c}") for c in ("size", "mtime_ns", "identity")])
    owner = documents.select(key, F.col("identity").alias("own_identity"))
    j = results.join(now, "path", "left").join(owner, key)
    same = F.lit(True)
    for c in ("size", "mtime_ns", "identity"):
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    j = j.where(F.col("identity").eqNullSafe(F.col("own_identity")))
    status = F.when(same, F.col("status")).otherwise("pending")
    return j.select(key, status.alias("status"), F.when(same, F.col("reason")).otherwise("changed_during_read").alias("reason"), (same & ~F.col("status").isin(*UNFINISHED)).alias("publish"))


def commit_batch(queue: DataFrame, outcome: DataFrame, now: float, interval: float = 60.0, key: str = "doc_id") -> DataFrame:
    """The queue after a batch: all of it is published and leaves, or nothing is and only failed files wait.

    ``outcome``: key, failed. Without a failure the batch's entries go. With one the batch rolls back: failed files
    get an attempt more and a delay that doubles up to an hour, the others stay due as they were.
    """
    any_failed = outcome.agg(F.coalesce(F.bool_or("failed"), F.lit(False)).alias("__any"))
    j = queue.join(outcome.select(key, "failed"), key, "left").join(F.broadcast(any_failed))  # one row
    j = j.where(F.col("__any") | F.col("failed").isNull())
    wait = F.least(F.lit(3600.0), F.lit(float(interval)) * F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(6))))
    failed = F.coalesce("failed", F.lit(False))
    return j.select(key, F.when(failed, F.lit(float(now)) + wait).otherwise(F.col("available_at").cast("double")).alias("available_at"), F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), "priority")


def revoked(documents: DataFrame, allowed: Column, content_allowed: Column) -> DataFrame:
    """What a narrower scope takes back: ``doc_id, action`` (remove, clear) of the documents it concerns, read in one pass."""
    held = F.col("status").isin("ready", "partial", "pending")
    action = F.when(~allowed, "remove").when(~content_allowed & held, "clear")
    return documents.select("doc_id", action.alias("action")).where("action is not null")


def scope_preview(documents: DataFrame, allowed: Column, content_allowed: Column) -> DataFrame:
    """One row: known files, how many a new scope would remove, and how many would lose their content. Nothing is applied."""
    gone = revoked(documents, allowed, content_allowed)
    counts = gone.agg(F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") == "clear").alias("content_removed"))
    return documents.agg(F.count("*").alias("checked")).join(counts)


def reconcile_targets(changes: DataFrame, directories: DataFrame, allowed: Column) -> DataFrame:
    """Directories to list again after changes (path, is_directory): ``target, full``.

    A change of a directory that is still there concerns itself, of one that is gone its parent; where the target is out of scope the
    whole scope is checked (``full``, without a target). ``directories``: path of those that exist.
    """
    c = changes.where("is_directory").select("path").distinct()
    there = directories.select("path", F.lit(True).alias("__there")).distinct()
    parent = F.regexp_replace("path", "/[^/]*$", "")
    target = c.join(there, "path", "left").select(F.when(F.col("__there"), F.col("path")).otherwise(F.when(parent == "", F.lit("/")).otherwise(parent)).alias("path"))
    marked = target.select("path", allowed.alias("__ok"))
    return marked.select(F.when(F.col("__ok"), F.col("path")).alias("target"), (~F.col("__ok")).alias("full")).distinct()


def watched_events(events: DataFrame, roots: list[str]) -> DataFrame:
    """A watcher's events below its roots (1 to 32), one a path: ``path, is_directory, version, first_at, last_at``."""
    if not 1 <= len(roots) <= 32:
        raise ValueError("a watcher has 1 to 32 roots")
    below = F.lit(False)
    for r in roots:
        top = r.rstrip("/")
        below = below | (F.col("path") == (top or "/")) | F.col("path").startswith(top + "/")
    return events.where(below).groupBy("path").agg(F.bool_or("is_directory").alias("is_directory"), F.count("*").alias("version"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def prioritized(queue: DataFrame, requests: DataFrame, documents: DataFrame, allowed: Column, key: str = "doc_id") -> DataFrame:
    """The queue after requests (path) to do files first: allowed ones are due at once and urgent, new entries included."""
    wanted = documents.join(requests.select("path").distinct(), "path", "left_semi").where(allowed).select(key)
    kept = queue.join(wanted, key, "left_anti")
    again = wanted.join(queue.select(key, "attempts"), key, "left").select(key, F.lit(0.0).alias("available_at"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.lit(1).alias("priority"))
    return kept.select(key, F.col("available_at").cast("double").alias("available_at"), "attempts", "priority").unionByName(again)


def file_identity(device: Column, inode: Column) -> Column:
    """Device and inode as one text; a file without an inode has none that can be trusted."""
    return F.when(F.coalesce(inode, F.lit(0)) != 0, F.concat_ws(":", device.cast("string"), inode.cast("string"))).otherwise("unavailable")


@dataclass(frozen=True)
class Discovery:
    """What a scan found: ``files`` (path, size, mtime_ns, identity, generation), ``errors`` (path, error), and whether every folder was read.

    Only a ``complete`` scan says anything about files it has not found: sweep then, and never otherwise.
    """

    files: DataFrame
    errors: DataFrame
    generation: str
    rounds: int
    complete: bool


_FOUND = "kind string, path string, size long, mtime_ns long, identity string, error string"


def discover(spark: SparkSession, roots: list[str], excluded: list[str] = (), slices: int = 64, first: int = 16, most: int = 4096) -> Discovery:
    """Scans the roots in rounds: a task lists so many folders and hands on those that it has not opened, which are dealt anew.

    So one deep or wide root is all tasks' work after a round or two. ``first`` folders a task at first, four times as many each round, up to ``most``.
    Links are left out, excluded paths with all below them. For folders that all executors see under the same path. What is open
    between rounds is a written table; the driver sees its count.
    """
    generation, base = uuid.uuid4().hex, f"{work_folder(spark)}/scan-{uuid.uuid4().hex}"
    gone = {x.rstrip("/") for x in excluded}

    def scan(limit: int):
        def run(batches):
            waiting, found, listed = [], [], 0
            for batch in batches:
                waiting += batch.column(0).to_pylist()
            while waiting:
                path = waiting.pop()
                if listed >= limit:
                    found.append(("open", path, None, None, None, None))
                else:
                    listed += 1
                    try:
                        with os.scandir(path) as entries:
                            for e in entries:
                                if e.path in gone or e.is_symlink():
                                    continue
                                if e.is_dir(follow_symlinks=False):
                                    waiting.append(e.path)
                                elif e.is_file(follow_symlinks=False):
                                    found.append(_file_row(e.path))
                                if len(found) >= 5000:
                                    yield _found(found)
                                    found = []
                    except OSError as e:
                        found.append(("error", path, None, None, None, type(e).__name__))
            if found:
                yield _found(found)

        return run

    tops = [r for r in minimal_roots(roots) if r not in gone]
    held = spark.createDataFrame([("file" if os.path.isfile(r) else "open", r) for r in tops], "kind string, path string")
    single = [_file_row(r) for r in tops if os.path.isfile(r) and not os.path.islink(r)]
    spark.createDataFrame(single, _FOUND).write.parquet(f"{base}/round=0")
    opened, rounds = held.where("kind = 'open'").select("path"), 0
    count = len(tops) - len(single)
    while count:
        rounds += 1
        at = f"{base}/round={rounds}"
        opened.repartition(max(1, min(slices, count)), F.xxhash64("path")).mapInArrow(scan(min(most, first * 4 ** (rounds - 1))), _FOUND).write.parquet(at)
        opened = spark.read.schema(_FOUND).parquet(at).where("kind = 'open'").select("path")
        count = opened.count()
    every = spark.read.schema(_FOUND).option("basePath", base).parquet(*[f"{base}/round={n}" for n in range(rounds + 1)])
    files = every.where("kind = 'file'").select("path", "size", "mtime_ns", "identity", F.lit(generation).alias("generation"))
    errors = every.where("kind = 'error'").select("path", "error")
    return Discovery(files, errors, generation, rounds, errors.limit(1).count() == 0)


def _file_row(path: str) -> tuple:
    try:
        s = os.stat(path, follow_symlinks=False)
    except FileNotFoundError as e:  # it went between listing and looking
        return "error", path, None, None, None, type(e).__name__
    return "file", path, s.st_size, s.st_mtime_ns, f"{s.st_dev}:{s.st_ino}" if s.st_ino else "unavailable", None


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "path", "size", "mtime_ns", "identity", "error"])


def local_files(spark: SparkSession, roots: list[str], excluded: list[str] = (), slices: int = 64) -> DataFrame:
    """Files below the roots, links left out: ``path, size, mtime_ns, identity, error``; a folder that cannot be read gives a row with ``error``."""
    d = discover(spark, roots, excluded, slices)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("mtime_ns", "long"), ("identity", "string"))]
    return d.files.select("path", "size", "mtime_ns", "identity", F.lit(None).cast("string").alias("error")).unionByName(d.errors.select("path", *none, "error"))
