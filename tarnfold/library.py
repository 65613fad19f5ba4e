"""One object for the whole query surface: search, structured queries, evidence and status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import evidence, search
from tarnfold.operators.index import KeywordIndex
from tarnfold.operators.paths import PathIndex
from tarnfold.plans.structured import Source


@dataclass
class Library:
    """An index and its sources.

    ``documents``: doc_id, source_id, path, name, extension, size, mtime_ns, status, indexed_at, ...;
    ``chunks``: chunk_id, doc_id, ordinal, text, hash, semantic; ``vectors``: chunk_id, embedding;
    ``encode``: query text to a vector; ``index``: a keyword index of the chunks (with doc_id), without which texts are scanned;
    ``paths``: a path index of the documents, without which paths are.
    """

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    sources: dict[str, Source] = field(default_factory=dict)
    encode: Callable[[str], list[float]] | None = None
    index: KeywordIndex | None = None
    paths: PathIndex | None = None

    def _words(self, query: str, scope: DataFrame | None) -> DataFrame:
        """chunk_id, doc_id, value (the rounded score) of every chunk that the query finds."""
        if self.index is not None:
            hits = self.index.scores(query).join(self.index.documents.select("chunk_id", "doc_id"), "chunk_id")
            if scope is not None:
                hits = hits.join(scope.select("doc_id"), "doc_id", "left_semi")
        else:
            held = self.chunks if scope is None else self.chunks.join(scope.select("doc_id"), "doc_id", "left_semi")
            hits = search.keyword_scores(self.chunks, query, held)
        return hits.select("chunk_id", "doc_id", F.round("score", 9).alias("value"))

    def search(self, query: str, mode: str = "hybrid", limit: int = 20, filters: search.Filters | None = None, sort: str = "relevance", fold_duplicates: bool = False) -> DataFrame:
        """The best chunk of each matching document, best document first.

        ``doc_id, chunk_id, score`` (files: no chunk), the document's columns, and with
        ``fold_duplicates`` the other documents of equal content as ``other_locations``.
        """
        limit = search.check_request(query, mode, limit, sort)
        scope = filters.apply(self.documents) if filters else self.documents
        if mode == "files" and self.paths is not None:
            return self.paths.search(query, limit, filters, sort)
        if mode == "files":
            return search.filename_search(self.documents, query, limit, filters, sort)
        lists = {}
        if mode in ("keyword", "hybrid"):
            words = self._words(query, scope if filters else None)
            if mode == "keyword":
                best = search.best_of(words, "doc_id", "value", "chunk_id").withColumnRenamed("value", "score")
                page = best.join(scope, "doc_id").orderBy(*search.ordering(sort, F.col("doc_id"))).limit(limit)
                return self._folded(page, search.ordering(sort, F.col("doc_id")), fold_duplicates)
            lists["keyword"] = words
        if self.vectors is not None and self.encode is not None:
            live = self.chunks.where("semantic").join(scope.select("doc_id"), "doc_id", "left_semi").select("chunk_id", "doc_id")
            distance = F.round(search.cosine_distance(F.col("embedding"), self.encode(query)), 6)
            lists["semantic"] = self.vectors.join(live, "chunk_id").select("chunk_id", "doc_id", distance.alias("value"))
        if not lists:
            return self.chunks.select("doc_id", "chunk_id", F.lit(0.0).alias("score")).limit(0)
        by_score = [F.desc(F.round("score", 9)), F.col("chunk_id")]
        page = search.fused_documents(lists, limit, "chunk_id", "doc_id")
        if mode == "hybrid" and sort == "relevance":
            page = search.exact_names_first(page, scope, query, limit).join(page.select("doc_id", "chunk_id", "matches"), "doc_id", "left")
        else:
            page = page.withColumn("exact", F.lit(False))
        order = {"modified_desc": [F.desc("mtime_ns"), F.desc("doc_id")], "modified_asc": [F.asc("mtime_ns"), F.col("doc_id")], "name": [F.lower("name"), F.col("doc_id")]}.get(sort, [F.desc("exact"), *by_score])
        return self._folded(scope.join(F.broadcast(page), "doc_id").orderBy(*order), order, fold_duplicates)  # a page of at most 100

    def _folded(self, page: DataFrame, order: list, wanted: bool) -> DataFrame:
        if not wanted:
            return page
        digests = search.content_digest(self.chunks.join(page.select("doc_id"), "doc_id", "left_semi"))
        return search.fold(page.join(digests, "doc_id", "left"), F.coalesce("digest", F.col("doc_id").cast("string")), "doc_id", order, F.col("status") == "ready").orderBy(*order)

    def query_database(self, source_id: str, request: dict) -> dict:
        return self._source(source_id).query(request)

    def inspect_source(self, source_id: str) -> DataFrame:
        return self._source(source_id).inspect(self.documents.sparkSession)

    def _source(self, source_id: str) -> Source:
        if source_id not in self.sources:
            raise KeyError("unknown source")
        return self.sources[source_id]

    def fetch(self, doc_id, offset: int = 0, limit: int = 5) -> DataFrame:
        return evidence.fetch_page(self.chunks, doc_id, offset, limit)

    def read_context(self, chunk_id, before: int = 1, after: int = 2) -> DataFrame:
        """The chunk, its neighbours and how far they are from it."""
        return evidence.neighbours(self.chunks, self.chunks.where(F.col("chunk_id") == chunk_id).select("doc_id", "chunk_id"), before, after).orderBy("distance")

    def diagnose_path(self, requests: DataFrame, query: str | None = None) -> DataFrame:
        """``path, code, actions`` and, with a query, whether a ready path answers it."""
        found = evidence.with_actions(evidence.diagnose(requests, self.documents))
        return found if query is None else evidence.query_evidence(found, self.documents, self.chunks, query)

    def index_status(self) -> dict[str, DataFrame]:
        """Counts by source and status, states of sources, and how many chunks have a vector."""
        status = {"counts": evidence.status_counts(self.documents), "sources": evidence.source_states(self.documents)}
        if self.vectors is not None:
            known = self.vectors.join(self.chunks.select("chunk_id", "hash"), "chunk_id").select("hash")
            status["coverage"] = evidence.coverage(self.chunks, known)
        return status
