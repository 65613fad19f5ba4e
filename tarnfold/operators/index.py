"""A written keyword index: postings by term in segments behind numbered manifests, read by bands of length.

A segment is never changed. It has three tables below the index's folder, each parted by ``segment``:

* ``postings``: term, key, tf, positions, length; parted by a hash of the term, each file sorted by term and length;
* ``terms``: a row a term: how many rows hold it, and for each band of lengths how many and their largest tf;
* ``documents``: the rows' other columns without the text, with their length and their tokens as one string, of which postings
  are made when a segment is written or written anew, and of which many queries at once are answered.

``apply`` writes one segment of the added and changed rows, and marks what they replace or delete as dead: ``dead`` (segment, key) and
``gone`` (segment, term, how many rows left it), so that frequencies stay exact without reading a posting. ``compact`` writes
segments anew that have lost much, and the smallest where there are many. Each publishes the next manifest; a reader keeps the one it
opened. Two writers never lose each other's work: who comes second starts again from the other's manifest.

**Top-k without every posting.** A row's score in a term grows with tf and falls with its length, and all of a row's postings lie in
the band of its length. So a band's largest tf and least length bound the score of any row in it. Bands are read from the highest
bound on; once the page's last score is better than the bounds of all other bands, those are not read: the scan's filters on
term and length leave their row groups and pages out.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.text import bm25_term, query_phrases
from tarnfold.operators.forward import TOKENS, best_rows, distinct_tokens, postings_of, with_tokens
from tarnfold.operators.maintain import Snapshot
from tarnfold.operators.search import Filters, check_request, ordering, ranked

#: Bands of a segment's lengths.
BANDS = 32
#: Small row groups and pages, so that a scan skips what its filters leave out.
_FINE = {"parquet.block.size": str(4 << 20), "parquet.page.row.count.limit": "2000", "compression": "zstd"}
#: Scores are compared to nine digits; a band is left out if its bound is worse by more than that.
_SLACK = 2e-9

#: Terms of all queries of a batch that go to every task; more of them are joined.
_WANTED = 500_000
_BANDS = T.StructType().add("band", "integer").add("n", "long").add("most", "long")
_KINDS = {
    "postings": T.StructType().add("term", "string").add("length", "integer").add("tf", "long").add("positions", T.ArrayType(T.IntegerType())),
    "terms": T.StructType().add("bucket", "integer").add("term", "string").add("with", "long").add("bands", T.ArrayType(_BANDS)),
}


def _parted(kind: T.StructType, key: str, key_type: T.DataType, table: str) -> str:
    """A table's schema as JSON, with its key and the columns of its folders."""
    fields = [f for f in kind.fields if f.name != key]
    if table != "terms":
        fields.insert(0, T.StructField(key, key_type))
    if table == "postings":
        fields.append(T.StructField("bucket", T.IntegerType()))
    return T.StructType([*fields, T.StructField("segment", T.StringType())]).json()


@dataclass(frozen=True)
class Segment:
    """``rows`` and ``tokens`` as written; ``lost`` those dead by now, of the passes in ``dead``; ``edges``: the last length of each band but one."""

    name: str
    rows: int
    tokens: int
    edges: tuple[int, ...]
    dead: tuple[str, ...] = ()
    lost_rows: int = 0
    lost_tokens: int = 0


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str
    key: str
    text: str
    buckets: int
    generation: int
    segments: tuple[Segment, ...]
    schemas: tuple[tuple[str, str], ...] = ()
    kind: str = "words"
    #: Postings that the first look of a page may read at once; fewer of them are not worth another look.
    least_read: ClassVar[int] = 100_000
    most_wanted: ClassVar[int] = _WANTED

    # ---- building and changing ----

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = 64, kind: str = "words") -> KeywordIndex:
        """Writes the index of ``rows``, of which the key is unique; all columns but the text can be filtered and shown later.

        ``kind``: how texts are cut, as one of ``TOKENS``.
        """
        spark = rows.sparkSession

        def change(old: KeywordIndex) -> tuple[Segment, ...]:
            if old.generation or Snapshot(spark, path).manifest()["generation"]:
                raise FileExistsError(f"{path} has an index; open it and apply changes")
            return (old._written(rows),)

        kinds = {**_KINDS, "documents": rows.drop(text).limit(0).withColumns({"__length": F.lit(0), "__tokens": F.lit("")}).schema}
        kinds = {t: _parted(k, key, rows.schema[key].dataType, t) for t, k in kinds.items()}
        return cls(spark, path.rstrip("/"), key, text, buckets, 0, (), tuple(sorted(kinds.items())), kind)._publish(change)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        """The index as its last manifest has it."""
        m = Snapshot(spark, path).manifest()
        if not m["generation"]:
            raise FileNotFoundError(f"{path} has no index")
        held = tuple(Segment(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in m["segments"])
        return cls(spark, path.rstrip("/"), m["key"], m["text"], m["buckets"], m["generation"], held, tuple(map(tuple, m["schemas"])), m["kind"])

    def _publish(self, change: Callable[[KeywordIndex], tuple[Segment, ...]], tries: int = 20) -> KeywordIndex:
        manifests, old = Snapshot(self.spark, self.path), self
        for _ in range(tries):
            held = change(old)
            if held == old.segments and old.generation:
                return old
            new = {"current": None, "previous": None, "generation": old.generation + 1, "key": self.key, "text": self.text, "buckets": self.buckets, "schemas": old.schemas, "kind": old.kind, "segments": [vars(s) for s in held], "before": [s.name for s in old.segments]}
            if manifests._claim(new):
                return KeywordIndex(self.spark, self.path, self.key, self.text, self.buckets, new["generation"], held, old.schemas, old.kind)
            old = KeywordIndex.open(self.spark, self.path)
        raise RuntimeError("other writers were always first")

    def _written(self, rows: DataFrame) -> Segment:
        """A segment of these rows."""
        return self._segment(with_tokens(rows, self.text, self.kind))

    def _segment(self, documents: DataFrame) -> Segment:
        """A segment of rows with their tokens, written where they lie; their postings are made of what was written."""
        name = f"s{uuid.uuid4().hex}"
        at = lambda table: f"{self.path}/{table}/segment={name}"
        documents.write.options(**_FINE).parquet(at("documents"))
        forward = self.spark.read.schema(self._kind("documents")).parquet(at("documents"))
        shares = F.percentile_approx("__length", [k / BANDS for k in range(1, BANDS)], 10_000)
        facts = forward.agg(F.count("*").alias("rows"), F.sum("__length").alias("tokens"), shares.alias("edges")).first()
        edges = tuple(sorted(set(facts["edges"] or ())))
        made = postings_of(forward, self.key, self.buckets, facts["tokens"] or 0, edges)
        with _unsorted_writes(spark=self.spark, folders=self.buckets):
            made.write.options(**_FINE).partitionBy("bucket").parquet(at("postings"))
        # only the postings that stand for a band; dealt by term once: the sums of a band and the term's list of bands are made where its rows come together
        heads = self.spark.read.schema("term string, band int, n long, most long, bucket int").parquet(at("postings")).where("band is not null")
        by_band = heads.repartition("bucket", "term").groupBy("bucket", "term", "band").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        terms = by_band.groupBy("bucket", "term").agg(F.sum("n").alias("with"), F.array_sort(F.collect_list(F.struct("band", "n", "most"))).alias("bands"))
        terms.sortWithinPartitions("bucket", "term").write.options(**_FINE).parquet(at("terms"))
        return Segment(name, facts["rows"], facts["tokens"] or 0, edges)

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> KeywordIndex:
        """The index after ``changed`` rows (added, or in place of those of their key) and without the ``deleted`` keys.

        Written are the changed rows' postings and what they take from segments that hold their keys; no other posting is read or written.
        """
        gone = [df.select(self.key) for df in (changed, deleted) if df is not None]
        if not gone:
            return self
        keys = reduce(DataFrame.unionByName, gone).where(F.col(self.key).isNotNull()).distinct()

        def change(old: KeywordIndex) -> tuple[Segment, ...]:
            held = old._without(keys)
            if changed is not None and changed.limit(1).count():
                held = (*held, old._written(changed))
            return held

        return self._publish(change)

    def _without(self, keys: DataFrame) -> tuple[Segment, ...]:
        if not self.segments:
            return ()
        made = f"p{uuid.uuid4().hex}"
        lost = self._documents("segment", self.key, "__length").join(keys, self.key, "left_semi")
        lost.write.partitionBy("segment").parquet(f"{self.path}/dead/made={made}")
        written = self.spark.read.schema(lost.schema).parquet(f"{self.path}/dead/made={made}")
        facts = {r["segment"]: r for r in written.groupBy("segment").agg(F.count("*").alias("rows"), F.sum("__length").alias("tokens")).collect()}  # a row a segment
        if not facts:
            self._delete("dead", f"made={made}")
            return self.segments
        texts = self._documents("segment", self.key, "__tokens").join(written, ["segment", self.key], "left_semi")  # keys alone are written: small enough to go to the rows
        counts = texts.select("segment", F.explode(distinct_tokens(F.col("__tokens"))).alias("term")).groupBy("segment", "term").agg(F.count("*").alias("with"))
        counts.sortWithinPartitions("segment", "term").write.partitionBy("segment").parquet(f"{self.path}/gone/made={made}")
        out = []
        for s in self.segments:
            if f := facts.get(s.name):
                s = Segment(s.name, s.rows, s.tokens, s.edges, (*s.dead, made), s.lost_rows + f["rows"], s.lost_tokens + f["tokens"])
            if s.lost_rows < s.rows or not s.rows:
                out.append(s)
        return tuple(out)

    def compact(self, ratio: float = 0.3, most: int = 8) -> KeywordIndex:
        """Writes segments anew that have lost ``ratio`` of their rows, and the smallest, where there are more than ``most``, as one."""

        def change(old: KeywordIndex) -> tuple[Segment, ...]:
            live = {s.name: s.rows - s.lost_rows for s in old.segments}
            again = {s.name for s in old.segments if s.rows and s.lost_rows / s.rows >= ratio}
            rest = sorted((n for n in live if n not in again), key=lambda n: (live[n], n))
            extra = len(rest) + bool(again) - most
            again |= set(rest[: extra + 1 if extra > 0 and not again else max(0, extra)])
            if not again:
                return old.segments
            part = KeywordIndex(self.spark, self.path, self.key, self.text, self.buckets, old.generation, tuple(s for s in old.segments if s.name in again), old.schemas, old.kind)
            made = part._segment(part._documents().drop("segment"))
            return (*(s for s in old.segments if s.name not in again), made)

        return self._publish(change)

    def collect_garbage(self) -> list[str]:
        """Deletes segments and dead lists that neither the last manifest nor the one before it names. Run it while nothing is being written."""
        manifests = Snapshot(self.spark, self.path)
        m = manifests.manifest()
        used = {s["name"] for s in m["segments"]} | {d for s in m["segments"] for d in s["dead"]} | set(m["before"])
        gone = set()
        for table in ("postings", "terms", "documents", "dead", "gone"):
            root = manifests._path(table)
            for f in manifests.files.listStatus(root) if manifests.files.exists(root) else []:
                name = f.getPath().getName()
                if (short := name.split("=", 1)[-1]) not in used and not (table in ("dead", "gone") and self._named_before(m, short)):
                    self._delete(table, name)
                    gone.add(short)
        manifests.collect_garbage()
        return sorted(gone)

    def _named_before(self, manifest: dict, made: str) -> bool:
        """Whether a dead list belongs to a segment of the manifest before the last, which readers may still have open."""
        manifests = Snapshot(self.spark, self.path)
        root = manifests._path("dead", f"made={made}")
        names = [f.getPath().getName() for f in manifests.files.listStatus(root)] if manifests.files.exists(root) else []
        return any(n.split("=", 1)[-1] in manifest["before"] for n in names)

    def _delete(self, *parts: str) -> None:
        manifests = Snapshot(self.spark, self.path)
        manifests.files.delete(manifests._path(*parts), True)

    # ---- reading ----

    @cached_property
    def rows(self) -> int:
        return sum(s.rows - s.lost_rows for s in self.segments)

    @cached_property
    def average(self) -> float:
        return sum(s.tokens - s.lost_tokens for s in self.segments) / self.rows if self.rows else 0.0

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def _table(self, table: str) -> DataFrame:
        if table not in self._read:  # segments do not change: their files are listed once
            paths = [f"{self.path}/{table}/segment={s.name}" for s in self.segments]
            self._read[table] = self.spark.read.schema(self._kind(table)).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return self._read[table]

    @cached_property
    def _read(self) -> dict[str, DataFrame]:
        return {}

    def _kind(self, table: str) -> T.StructType:
        """The table's columns, so that a segment without rows, or without a new column, can be read."""
        return T.StructType.fromJson(json.loads(dict(self.schemas)[table]))

    @cached_property
    def dead(self) -> DataFrame | None:
        """segment, key of rows that are in a segment no more; None where there are none."""
        return self._lost("dead", "segment", self.key)

    def _lost(self, table: str, *columns: str) -> DataFrame | None:
        paths = [f"{self.path}/{table}/made={d}/segment={s.name}" for s in self.segments for d in s.dead]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths).select(*columns)

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(self.dead, ["segment", self.key], "left_anti")

    def _postings(self) -> DataFrame:
        return self._alive(self._table("postings"))

    def _documents(self, *columns: str) -> DataFrame:
        held = self._table("documents")
        return self._alive(held.select(*columns) if columns else held)

    @cached_property
    def postings(self) -> DataFrame:
        return self._postings().drop("segment")

    @cached_property
    def documents(self) -> DataFrame:
        """The indexed rows' columns, without their texts."""
        return self._documents().drop("segment", "__length", "__tokens")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """bucket, term, with (rows that hold it)."""
        held = self._table("terms").select("bucket", "term", "with")
        lost = self._lost("gone", "term", "with")
        if lost is not None:
            held = held.unionByName(lost.select(self._bucket(F.col("term")).alias("bucket"), "term", (-F.col("with")).alias("with")))
        if len(self.segments) > 1 or lost is not None:
            held = held.groupBy("bucket", "term").agg(F.sum("with").alias("with")).where(F.col("with") > 0)
        return held

    def frequencies(self, wanted: list[str]) -> dict[str, int]:
        """How many rows hold each of these terms (those of one query)."""
        return {r["term"]: r["with"] for r in self.vocabulary.where(self._of(wanted)).collect()}

    def _of(self, wanted: list[str]) -> Column:
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})
        return F.col("bucket").isin(buckets) & F.col("term").isin(sorted(wanted))

    def terms(self, wanted: list[str]) -> DataFrame:
        """The postings of these terms, read from their buckets only."""
        return self._alive(self._table("postings").where(self._of(wanted)))

    def scores(self, query: str) -> DataFrame:
        """``key, score`` of every row in which any phrase occurs (BM25, smaller is better)."""
        phrases = query_phrases(query)
        wanted = sorted({t for p in phrases for t in p})
        names = [f"__tf{i}" for i in range(len(phrases))]
        if not self.segments or not wanted:
            return self._nothing()
        held = self.terms(wanted)
        if all(len(p) == 1 for p in phrases):  # what the vocabulary knows: a row's score is a sum over its postings
            frequency = self.frequencies(wanted)
            return self._summed(held, frequency) if frequency else self._nothing()
        counted = held.groupBy(self.key, "length").agg(*[self._count(p).alias(n) for p, n in zip(phrases, names, strict=True)])
        with_phrase = counted.agg(*[F.count_if(F.col(n) > 0).alias(f"{n}_rows") for n in names])
        found = counted.where(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names], F.lit(False))).join(F.broadcast(with_phrase))  # one row
        parts = [bm25_term(F.col(n), F.col(f"{n}_rows"), F.lit(self.rows), F.col("length"), F.lit(self.average)) for n in names]
        return found.select(self.key, reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([self._kind("documents")[self.key], T.StructField("score", T.DoubleType())]))

    def _summed(self, held: DataFrame, frequency: dict[str, int]) -> DataFrame:
        with_term = F.create_map(*[F.lit(x) for t, n in frequency.items() for x in (t, n)])[F.col("term")]
        part = bm25_term(F.col("tf"), with_term, F.lit(self.rows), F.col("length"), F.lit(self.average))
        return held.select(self.key, part.alias("part")).groupBy(self.key).agg(F.sum("part").alias("score"))

    def _count(self, phrase: list[str]) -> Column:
        """How often a group's row holds the phrase: the term's frequency, or the places that all its words agree on."""
        if len(phrase) == 1:
            return F.coalesce(F.max(F.when(F.col("term") == phrase[0], F.col("tf"))), F.lit(0))

        def starts(k: int) -> Column:
            return F.transform(F.max(F.when(F.col("term") == phrase[k], F.col("positions"))), lambda x: x - k)

        common = reduce(F.array_intersect, [starts(k) for k in range(len(phrase))])
        return F.when(common.isNull(), 0).otherwise(F.size(common))

    # ---- pages ----

    def looked_up(self, wanted: list[str]) -> tuple[dict[str, int], list]:
        """How many rows hold each term, and the terms' rows (segment, term, with, bands), which are one a term and segment."""
        rows = self._table("terms").where(self._of(wanted)).select("segment", "term", "with", "bands").collect() if wanted and self.segments else []
        out: dict[str, int] = {}
        lost = self._lost("gone", "term", "with")
        for r in [*rows, *(lost.where(F.col("term").isin(wanted)).select("term", (-F.col("with")).alias("with")).collect() if rows and lost is not None else [])]:
            out[r["term"]] = out.get(r["term"], 0) + r["with"]
        return {t: n for t, n in out.items() if n > 0}, rows

    def bounds(self, frequency: dict[str, int], rows: list) -> list[tuple[float, int, str, int, int]]:
        """(best score that a row can have, postings, segment, least length, last length) of each band that holds a term, best first."""
        held: dict[tuple[str, int], list] = {}
        for r in rows:
            for b in r["bands"]:
                held.setdefault((r["segment"], b["band"]), []).append((r["term"], b["n"], b["most"]))
        edges, out = {s.name: s.edges for s in self.segments}, []
        for (name, band), parts in held.items():
            low = edges[name][band - 1] + 1 if band else 0
            high = edges[name][band] if band < len(edges[name]) else (1 << 31) - 1
            best = 0.0
            for term, _, tf in parts:
                if not (n := frequency.get(term, 0)):
                    continue
                best -= _weight(self.rows, n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * low / self.average))
            out.append((best, sum(n for _, n, _ in parts), name, low, high))
        return sorted(out)

    def _best(self, query: str, limit: int, scope: DataFrame | None) -> tuple[list, dict[str, int]]:
        """The first ``limit`` (score, key) by relevance, from as few bands as show that there are no others; and what was read."""
        wanted = sorted({t for p in query_phrases(query) for t in p})
        frequency, rows = self.looked_up(wanted)
        left = self.bounds(frequency, rows) if frequency else []
        page, read, most = [], {"bands": 0, "postings": 0, "of": sum(b[1] for b in left)}, self.least_read
        while left:
            if len(page) >= limit:
                left = [b for b in left if b[0] <= page[limit - 1][0] + _SLACK]
                most = sum(b[1] for b in left)  # all that can still matter, at once
            n = taken = 0
            while n < len(left) and (not n or taken + left[n][1] <= most):
                taken += left[n][1]
                n += 1
            if not n:
                break
            part, left, most = left[:n], left[n:], 8 * most
            read["bands"] += n
            read["postings"] += taken
            hits = self._summed(self._alive(self._table("postings").where(self._of(wanted) & _within(part))), frequency)
            if scope is not None:
                hits = hits.join(scope.select(self.key), self.key, "left_semi")
            found = hits.select(F.round("score", 9).alias("score"), self.key).orderBy("score", self.key).limit(limit).collect()
            page = sorted([*page, *map(tuple, found)])[:limit]
        return page, read

    def search(self, query: str, limit: int = 20, filters: Filters | None = None, sort: str = "relevance") -> DataFrame:
        """A page of documents with their columns and ``score``."""
        limit = check_request(query, "keyword", limit, sort)
        documents = self.documents if filters is None else filters.apply(self.documents)
        if sort == "relevance" and self.segments and all(len(p) == 1 for p in query_phrases(query)):
            page, _ = self._best(query, limit, None if filters is None else documents)
            hits = self.spark.createDataFrame([(k, s) for s, k in page], self._nothing().schema)
            shown = self.documents.where(F.col(self.key).isin([k for _, k in page])) if page else self.documents.limit(0)
            return F.broadcast(hits).join(shown, self.key).orderBy(*ordering(sort, F.col(self.key)))
        hits = self.scores(query)
        if filters is None and sort == "relevance":  # the page first, then its documents
            hits = hits.orderBy(*ordering(sort, F.col(self.key))).limit(limit)
        return hits.join(documents, self.key).orderBy(*ordering(sort, F.col(self.key))).limit(limit)

    def batch(self, queries: DataFrame, limit: int) -> DataFrame:
        """The first ``limit`` rows of each of many queries (query_id, term): ``query_id, key, score, rank``.

        The queries' terms go to the tasks, each of which scores its rows whole and hands on its best rows for each query. Only where they are
        more than ``most_wanted``, postings are joined with them, and parts of scores are shuffled.
        """
        wanted = queries.select("query_id", "term").distinct().withColumn("bucket", self._bucket(F.col("term"))).join(self.vocabulary, ["bucket", "term"])
        few = wanted.select("query_id", "term", "with").limit(self.most_wanted + 1).collect()
        if len(few) > self.most_wanted:
            return self._joined_batch(wanted, limit)
        ids = list({r["query_id"]: None for r in few})
        number = {q: i for i, q in enumerate(ids)}
        best = best_rows(self._documents(), self.key, [(number[r["query_id"]], r["term"], _weight(self.rows, r["with"])) for r in few], limit, self.average or 1.0)
        names = self.spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query_no", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
        top = ranked(best, F.round("score", 9), self.key, "query_no").where(F.col("rank") < limit)
        return top.join(F.broadcast(names), "query_no").select("query_id", self.key, "score", "rank")  # bounded by ``most_wanted``

    def _joined_batch(self, wanted: DataFrame, limit: int) -> DataFrame:
        hits = self.postings.select("bucket", "term", self.key, "tf", "length").join(wanted, ["bucket", "term"])
        part = bm25_term(F.col("tf"), F.col("with"), F.lit(self.rows), F.col("length"), F.lit(self.average))
        total = hits.select("query_id", self.key, part.alias("part")).groupBy("query_id", self.key).agg(F.sum("part").alias("score"))
        return ranked(total, F.round("score", 9), self.key, "query_id").where(F.col("rank") < limit)


@contextmanager
def _unsorted_writes(spark: SparkSession, folders: int) -> Iterator[None]:
    """A task keeps a file open for each of so many folders, instead of sorting its rows by folder first: deals are in that order already.

    A setting of the session that someone else has made stays as it is.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    if spark.conf.get(name, "0") != "0":
        yield
        return
    spark.conf.set(name, str(folders))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _weight(rows: int, having: int) -> float:
    """The weight of a term that so many rows have."""
    odds = (rows - having + 0.5) / (having + 0.5)
    return math.log(odds) if odds > 1 else 1e-6


def _within(bands: list[tuple]) -> Column:
    """Postings of these bands. Bands that touch are one range, and a segment of all of them has no range."""
    ranges: dict[str, list[list[int]]] = {}
    for _, _, name, low, high in sorted(bands, key=lambda b: (b[2], b[3])):
        own = ranges.setdefault(name, [])
        if own and own[-1][1] + 1 == low:
            own[-1][1] = high
        else:
            own.append([low, high])
    tests = [(F.col("segment") == name) & F.col("length").between(low, high) for name, own in sorted(ranges.items()) for low, high in own]
    return reduce(lambda a, b: a | b, tests)
