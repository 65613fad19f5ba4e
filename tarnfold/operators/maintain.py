"""Index maintenance as set algebra: diffs, upserts, sweeps, embedding queues, vector segments."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names and folders that are never indexed.
SENSITIVE_NAMES = frozenset({".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_rsa", "id_ed25519"})
SENSITIVE_FOLDERS = frozenset({".ssh", ".aws", ".azure", ".gnupg", ".kube"})


def chunk_diff(old: DataFrame, new: DataFrame, document: str = "doc_id") -> DataFrame:
    """Pairs the k-th old copy of a hash in a document with the k-th new copy.

    ``old``: document, chunk_id, ordinal, hash; ``new``: document, ordinal, hash. Returns document, hash,
    chunk_id, old_ordinal, new_ordinal and action: reused, written or removed.
    """
    nth = Window.partitionBy(document, "hash")
    a = old.withColumn("k", F.row_number().over(nth.orderBy("ordinal", "chunk_id"))).withColumnRenamed("ordinal", "old_ordinal")
    b = new.withColumn("k", F.row_number().over(nth.orderBy("ordinal"))).withColumnRenamed("ordinal", "new_ordinal")
    joined = a.join(b, [document, "hash", "k"], "full")
    action = F.when(F.col("new_ordinal").isNull(), "removed").when(F.col("old_ordinal").isNull(), "written").otherwise("reused")
    return joined.select(document, "hash", "chunk_id", "old_ordinal", "new_ordinal", action.alias("action"))


def metadata_upsert(known: DataFrame, seen: DataFrame) -> DataFrame:
    """What a file snapshot changes: key and action new, replaced, changed, same or unseen.

    Both: key, identity, size, mtime_ns. A new identity under an old key is another document.
    """
    a = known.select("key", *[F.col(c).alias(f"old_{c}") for c in ("identity", "size", "mtime_ns")], F.lit(True).alias("was"))
    b = seen.select("key", "identity", "size", "mtime_ns", F.lit(True).alias("now"))
    j = a.join(b, "key", "full")
    action = (
        F.when(F.col("now").isNull(), "unseen")
        .when(F.col("was").isNull(), "new")
        .when(~F.col("identity").eqNullSafe(F.col("old_identity")), "replaced")
        .when((F.col("size") != F.col("old_size")) | (F.col("mtime_ns") != F.col("old_mtime_ns")), "changed")
        .otherwise("same")
    )
    return j.select("key", action.alias("action"), F.coalesce("size", "old_size").alias("size"))


def sweep(known: DataFrame, seen: DataFrame, complete: bool, key: str = "key") -> DataFrame:
    """Rows to delete: unseen ones, and none unless the traversal was complete and without errors."""
    gone = known.join(seen.select(key).distinct(), key, "left_anti")
    return gone if complete else gone.limit(0)


def cascade(children: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Distinct hashes (with one text) of eligible chunks without a vector of this model."""
    have = embeddings.where(F.col("model") == model).select("hash").distinct()
    return chunks.where("semantic").join(have, "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))


def orphan_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.where("semantic").select("hash").distinct(), "hash", "left_anti")


def missing_members(chunks: DataFrame, embeddings: DataFrame, members: DataFrame) -> DataFrame:
    """Eligible chunks with a vector that no active segment holds, by (chunk_id, hash)."""
    ready = chunks.where("semantic").join(embeddings.select("hash").distinct(), "hash", "left_semi")
    return ready.select("chunk_id", "hash").join(members.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_anti")


def live_ratio(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """``segment, total, live, deleted_ratio``."""
    alive = chunks.where("semantic").select("chunk_id", "hash").withColumn("__live", F.lit(1))
    j = members.join(alive, ["chunk_id", "hash"], "left").groupBy("segment")
    out = j.agg(F.count("*").alias("total"), F.count("__live").alias("live"))
    return out.withColumn("deleted_ratio", 1 - F.col("live") / F.col("total"))


def compaction_plan(ratios: DataFrame, ratio: float = 0.3, most: int = 8, capacity: int = 20_000) -> dict[str, list]:
    """Segments to drop (empty), to rewrite (too many deleted) and to merge (too many segments)."""
    rows = sorted((r.segment, r.total, r.live) for r in ratios.collect())  # one row per segment
    drop = [s for s, _, live in rows if not live]
    rewrite = [s for s, total, live in rows if live and 1 - live / total >= ratio]
    rest = sorted((live, s) for s, _, live in rows if live and s not in rewrite)
    merge, held = [], 0
    wanted = len(rest) + len(rewrite) - most + 1  # that many become one
    for live, s in rest[: max(0, wanted)]:
        if held + live > capacity:
            break
        merge.append(s)
        held += live
    return {"drop": drop, "rewrite": rewrite, "merge": merge if len(merge) > 1 else []}


def documents_to_apply(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming database documents whose version is not the known one."""
    return incoming.join(known.select("key", "version"), ["key", "version"], "left_anti")


def migration_page(documents: DataFrame, version: int, size: int) -> DataFrame:
    return documents.where(F.coalesce("chunking_version", F.lit(0)) < version).orderBy("doc_id").limit(size)


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Every character that full case folding changes: to one character, and to several. Made by rule from the Unicode tables at hand."""
    one, more = {}, {}
    for c in map(chr, range(0x110000)):
        if (f := c.casefold()) != c:
            (one if len(f) == 1 else more)[c] = f
    return one, more


_ONE, _MORE = _folds()


def casefolded(text: Column) -> Column:
    """Full case folding: texts that differ in case only are equal, sharp s, final sigma and ligatures included."""
    out = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    wide = F.rlike(text, F.lit("[" + "".join(_MORE) + "]"))
    marked = out
    for c, f in _MORE.items():
        marked = F.replace(marked, F.lit(c), F.lit(f))
    return F.when(wide, marked).otherwise(out)


def is_sensitive(path: Column) -> Column:
    """Paths that are never indexed, whatever the case of their letters."""
    parts = F.split(casefolded(path), "/")
    name = F.element_at(parts, -1)
    return name.isin(sorted(SENSITIVE_NAMES)) | name.startswith(".env.") | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(SENSITIVE_FOLDERS)]))


def in_scope(path: Column, roots: list[str], excluded: list[str] = (), mode: str = "directories", names: list[str] = (), resolved: Column | None = None) -> Column:
    """Row-level eligibility by folder: mode all, directories or none.

    ``names``: folders and files of these names below a root are out, whatever the case of their letters (with mode all: anywhere).
    ``resolved``: the path without links; a path that is an alias of another one is out.
    """
    if mode not in ("all", "directories", "none"):
        raise ValueError("mode is all, directories or none")
    if mode == "none":
        return F.lit(False)
    out = F.array(*[casefolded(F.lit(n)) for n in names])

    def below(top):
        top = top.rstrip("/")
        return (path == (top or "/")) | path.startswith(top + "/")

    def kept(top):
        if not names:
            return F.lit(True)
        return ~F.arrays_overlap(F.split(casefolded(F.substr(path, F.lit(len(top.rstrip("/")) + 1))), "/"), out)

    ok = kept("") if mode == "all" else F.lit(False)
    for r in roots if mode == "directories" else ():
        ok = ok | below(r) & kept(r)
    for x in excluded:
        ok = ok & ~below(x)
    return ok if resolved is None else ok & path.eqNullSafe(resolved)


def minimal_roots(roots: list[str]) -> list[str]:
    """Roots that no other root contains."""
    clean = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in clean if not any(r != o and (o == "/" or r.startswith(o + "/")) for o in clean)]


class Snapshot:
    """Immutable table versions behind numbered manifests: write a version, then the next manifest.

    The manifest of the highest number holds. A manifest appears whole or not at all, by a rename that fails if the number is
    taken (another publisher then was first, and the next number is tried), and none is ever changed or
    deleted before a later one is there: readers always find one, and a crash at any point loses nothing that was published.
    Readers take the path once, so a later switch does not disturb them. The previous version stays readable; ``collect_garbage``
    deletes what the last manifest does not name.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _numbers(self) -> list[int]:
        names = [x.getPath().getName() for x in self.files.listStatus(self.root)] if self.files.exists(self.root) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"current": None, "previous": None, "generation": 0}
        return json.loads(self.spark.read.text(self._path(f"manifest-{numbers[-1]:012d}.json").toString(), wholetext=True).first()[0])

    def publish(self, df: DataFrame, tries: int = 20, **more) -> dict:
        name = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base}/{name}")
        for _ in range(tries):
            old = self.manifest()
            new = {"current": name, "previous": old["current"], "generation": old["generation"] + 1, **more}
            if self._claim(new):
                return new
        raise RuntimeError("other publishers were always first")

    def _claim(self, new: dict) -> bool:
        """Writes a manifest under its number; False if that number is taken."""
        jvm = self.spark._jvm
        fresh = self._path(f".manifest-{uuid.uuid4().hex}")
        stream = self.files.create(fresh, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        target = self._path(f"manifest-{new['generation']:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.files.makeQualified(fresh), self.files.makeQualified(target), options)
        except Exception:
            if not self.files.exists(target):
                raise
            self.files.delete(fresh, False)
            return False
        return True

    def read(self, which: str = "current") -> DataFrame:
        name = self.manifest()[which]
        if name is None:
            raise FileNotFoundError("nothing is published")
        return self.spark.read.parquet(f"{self.base}/{name}")

    def collect_garbage(self) -> list[str]:
        """Deletes versions that the last manifest does not name, and earlier manifests; a version that is being written is of no manifest, so run it when none is."""
        m = self.manifest()
        gone = []
        for number in self._numbers()[:-1]:
            self.files.delete(self._path(f"manifest-{number:012d}.json"), False)
        for s in self.files.listStatus(self.root):
            name = s.getPath().getName()
            if name.startswith("version-") and name not in (m["current"], m["previous"]):
                self.files.delete(s.getPath(), True)
                gone.append(name)
        return gone

    def compact(self, files: int) -> dict:
        return self.publish(self.read().coalesce(files))
