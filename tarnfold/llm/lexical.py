"""Ranked lexical search of many queries over whole documents, by Fagin's threshold algorithm.

Documents are dealt as they lie: a task holds a block of documents at a time as a forward index (a document's terms and
impacts) and as one list a term, sorted by impact. A query goes round its terms' lists, a few entries of each at a time; a document met
for the first time is looked up in the forward index for its whole score. It stops when the threshold, the sum of the impacts reached
in each list, is strictly below the k-th best score, so that ties are never cut. The best of earlier blocks of the task
count as found, and a block whose threshold starts below them is not read at all. What tasks hand on, ``limit`` rows a query, is merged.

Corpus statistics (documents, terms, frequencies) come from all documents in a first pass, which also writes the terms that
queries use, so texts are read and cut once a block of queries. Nothing is shuffled but statistics and the tasks' best rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import discard, raw_texts, written

#: A-Z as a-z; other ASCII but digits and small letters as a blank; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters above ASCII, A-Z lower-cased, of UTF-8."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all terms with repeats, and how many documents hold each term of the queries."""

    documents: int
    terms: int
    frequency: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.frequency[term] + 1)))


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """doc_id, n (its terms with repeats), terms and counts (those of the vocabulary, by number) of every document that has a term."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), raw_texts(batch.column(1))
            keep, lengths, terms, counts = [], [], [], []
            for i, t in enumerate(texts):
                found = terms_of(t)
                if not found:
                    continue
                keep.append(i)
                lengths.append(len(found))
                known = [x for x in map(vocabulary.get, found) if x is not None]
                own, tf = np.unique(np.array(known, np.int32), return_counts=True)
                terms.append(own)
                counts.append(tf)
            edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int32))
            flat = [np.concatenate(x).astype(kind) if x else np.zeros(0, kind) for x, kind in ((terms, np.int32), (counts, np.int64))]
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Block:
    """Some documents: the forward index and impact-sorted lists of their terms."""

    def __init__(self, ids: list, edges: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.ids, self.edges = ids, edges
        self.terms, self.impacts = terms, impacts
        owner = np.repeat(np.arange(len(ids)), np.diff(edges))
        order = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = owner[order], impacts[order]
        self.list_edges = np.searchsorted(terms[order], np.arange(size + 1))

    def lookup(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of documents by the forward index; ``wanted`` flags the query's terms."""
        first, n = self.edges[docs], self.edges[docs + 1] - self.edges[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        part = np.where(wanted[self.terms[at]], self.impacts[at], 0)
        total = np.concatenate([[0], np.cumsum(part)])
        return total[ends] - total[ends - n]

    def search(self, query: np.ndarray, best: Best, wanted: np.ndarray, step: int = 16) -> None:
        """Fagin's threshold algorithm over the lists of ``query``, into ``best``."""
        starts, ends = self.list_edges[query], self.list_edges[query + 1]
        seen = np.zeros(len(self.ids), bool)
        depth = 0
        while True:
            places = starts + depth
            open_ = places < ends
            if not open_.any():
                return
            reached = self.list_impacts[places[open_]]  # before this round nothing unseen scores more than their sum
            if best.full and int(reached.sum()) < best.least:
                return
            met = np.concatenate([self.list_docs[a : min(a + step, b)] for a, b in zip(places[open_], ends[open_], strict=True)])
            new = np.unique(met[~seen[met]])
            seen[new] = True
            if len(new):
                best.add(self.lookup(new, wanted), new, self.ids)
            depth += step
            step = min(2 * step, 4096)


class Best:
    """The best rows of one query: highest score first, then smallest document, null last."""

    def __init__(self, limit: int):
        self.limit, self.rows = limit, []

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.limit

    @property
    def least(self) -> int:
        return self.rows[-1][1]

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        good = scores > 0
        if self.full:
            good &= scores >= self.least
        if good.sum() > self.limit:  # ties of the last place stay until their documents are compared
            good &= scores >= np.partition(scores[good], -self.limit)[-self.limit]
        for s, d in zip(scores[good].tolist(), docs[good].tolist(), strict=True):
            self.rows.append(((-s, ids[d] is None, ids[d] or 0), s, ids[d]))
        self.rows.sort(key=lambda r: r[0])
        del self.rows[self.limit :]


def search(docs: DataFrame, items: DataFrame, limit: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", block_items: int = 2000, block_postings: int = 2_000_000) -> DataFrame:
    """The ``limit`` best documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    Items are taken in blocks of ``block_items`` (their terms and texts are the driver's), documents in blocks of ``block_postings``
    postings within a task; neither changes a result. A null or empty text, one without terms, and terms that no document holds match nothing. Rows
    that repeat a doc_id are documents of their own; equal scores are in order of doc_id, null last. Items that
    repeat an item_id are searched each for itself, and their ranks run on by score. Very long texts count whole. Empty tables give no rows; other
    columns are ignored. Scores are whole numbers: weight times impact, summed over an item's different terms.
    """
    parts, block = [], []
    rows = items.select(items[item].alias("item"), items[query].cast("string").alias("text"))
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == block_items:
            parts.append(_searched(docs, block, rows, limit, key, text, block_postings))
            block = []
    if block or not parts:
        parts.append(_searched(docs, block, rows, limit, key, text, block_postings))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "query")
    return out.withColumn("rank", F.row_number().over(by_item)).select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")


def _searched(docs: DataFrame, block: list[Row], rows: DataFrame, limit: int, key: str, text: str, block_postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted: list[list[int]] = []
    for r in block:
        wanted.append(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of((r["text"] or "").encode())}))
    index = written(forward_rows(docs, vocabulary, key, text), "forward", "zstd")
    total = index.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # the queries' terms
    stats = Statistics(total["documents"], total["terms"] or 0, {r["term"]: r["count"] for r in held})
    best = written(_best(index, wanted, stats, len(vocabulary), limit, block_postings), "best")
    discard(index)
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(block)], f"query int, item {rows.schema['item'].dataType.simpleString()}")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= limit)
    return top.join(F.broadcast(names), "query").drop("place")  # a block of items


def _best(index: DataFrame, wanted: list[list[int]], stats: Statistics, size: int, limit: int, block_postings: int) -> DataFrame:
    weights = np.zeros(size, np.int64)
    for t in stats.frequency:
        weights[t] = stats.weight(t)

    def run(batches):
        found = [Best(limit) for _ in wanted]
        queries = [np.array([t for t in q if weights[t] > 0], np.int64) for q in wanted]  # a term of no weight adds nothing
        flag = np.zeros(size, bool)
        ids: list = []
        lengths: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush():
            n, each = np.concatenate(lengths), np.concatenate(sizes)
            t, tf = np.concatenate(terms), np.concatenate(counts)
            m = 100 - 90 + 90 * n * stats.documents // stats.terms
            impacts = weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, each)))
            block = Block(ids, np.concatenate([[0], np.cumsum(each)]), t, impacts, size)
            for q, best in zip(queries, found, strict=True):
                flag[q] = True
                block.search(q, best, flag)
                flag[q] = False

        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column(0).to_pylist()
            lengths.append(batch.column(1).to_numpy())
            sizes.append(batch.column(2).value_lengths().to_numpy())
            terms.append(batch.column(2).flatten().to_numpy())
            counts.append(batch.column(3).flatten().to_numpy())
            held += len(terms[-1])
            if held >= block_postings:
                flush()
                ids, held = [], 0
                for x in (lengths, sizes, terms, counts):
                    x.clear()
        if ids:
            flush()
        out = [(i, d, s) for i, b in enumerate(found) for _, s, d in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")
