"""A path index: substring search by postings of character runs, with verification.

A path that holds the query holds all its runs of three characters (of CJK queries of one or two characters, that run), so
the paths of the query's rarest runs are candidates and only those are looked at. Segments, changes, deletions and merges
are those of the keyword index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.text import query_grams
from tarnfold.operators.index import KeywordIndex
from tarnfold.operators.search import Filters, check_request, filename_search

#: The rarest runs of a query that are read; verification does the rest.
RAREST = 4
#: So few candidates are looked up by key; more are joined.
FEW = 1000


@dataclass(frozen=True)
class PathIndex:
    """``path``, ``name`` and any other columns of documents, found by parts of the path."""

    runs: KeywordIndex

    @classmethod
    def build(cls, documents: DataFrame, folder: str, key: str = "doc_id", buckets: int = 64) -> PathIndex:
        return cls(KeywordIndex.build(_cut(documents), folder, key, "__cut", buckets, "path"))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PathIndex:
        return cls(KeywordIndex.open(spark, folder))

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> PathIndex:
        """After ``changed`` documents (new, moved or renamed) and without the ``deleted`` keys; paths of others are not read."""
        return PathIndex(self.runs.apply(None if changed is None else _cut(changed), deleted))

    def compact(self, ratio: float = 0.3, most: int = 8) -> PathIndex:
        return PathIndex(self.runs.compact(ratio, most))

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of the documents that have the query's rarest runs; None for a query too short to have runs."""
        grams = query_grams(query)
        if not grams or not self.runs.segments:
            return None
        known = self.runs.frequencies(grams)
        if len(known) < len(grams):  # a run that no path has
            return self.runs.documents.select(self.runs.key).limit(0)
        rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
        return self.runs.terms(rarest).groupBy(self.runs.key).agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select(self.runs.key)

    def narrowed(self, query: str) -> DataFrame:
        """Documents among which are all whose path holds the query."""
        found, key = self.candidates(query), self.runs.key
        if found is None:
            return self.runs.documents
        few = [r[0] for r in found.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return self.runs.documents.where(F.col(key).isin(few)) if few else self.runs.documents.limit(0)
        return self.runs.documents.join(found, key, "left_semi")

    def search(self, query: str, limit: int = 20, filters: Filters | None = None, sort: str = "relevance") -> DataFrame:
        """As ``filename_search`` over all documents: paths that hold the query, a file of that very name first."""
        check_request(query, "files", limit, sort)
        return filename_search(self.narrowed(query), query, limit, filters, sort, self.runs.key)


def _cut(documents: DataFrame) -> DataFrame:
    return documents.withColumn("__cut", F.col("path"))
