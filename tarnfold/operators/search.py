"""Retrieval: metadata filters, keyword, filename, vector and fused search, duplicate folding.

Everything is a DataFrame plan. Filters reach the scan; candidates are ranked exactly, as top-k where one
list is wanted; long texts are joined only to the rows that are shown.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.text import bm25_term, fold_ascii, index_tokens, phrase_count, query_phrases
from tarnfold.plans.folders import work_folder
from tarnfold.sources.files import TEXT_SUFFIXES

# File categories by extension.
_PROSE = ".txt .md .markdown .log .rst .tex"
_RECORDS = ".json .jsonl .yaml .yml .toml .ini .xml .conf .config .env"
CATEGORIES = {
    "document": frozenset(".pdf .docx .pptx .txt .md .markdown .rst .tex".split()),
    "spreadsheet": frozenset(".csv .tsv .xlsx".split()),
    "code": frozenset(TEXT_SUFFIXES) - frozenset(f"{_PROSE} {_RECORDS}".split()),
    "data": frozenset(".json .jsonl .xml .csv .tsv .yaml .yml .toml .ini .conf .config .env".split()),
    "image": frozenset(".jpg .jpeg .png .gif .webp .bmp .tif .tiff .heic".split()),
    "audio": frozenset(".mp3 .wav .flac .m4a .ogg".split()),
    "video": frozenset(".mp4 .mkv .mov .avi .webm".split()),
    "archive": frozenset(".zip .7z .rar .tar .gz".split()),
}
SORTS = ("relevance", "modified_desc", "modified_asc", "name")
RANK_BASE = 61


def nanoseconds(value: str) -> int:
    """ISO 8601 as epoch nanoseconds; without a zone it is UTC."""
    if not isinstance(value, str):
        raise ValueError("a date is ISO 8601 text")
    moment = datetime.fromisoformat(value.replace("Z", "+00:00"))
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    since = moment - datetime(1970, 1, 1, tzinfo=UTC)
    return ((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds) * 1000


@dataclass(frozen=True)
class Filters:
    """Metadata conditions, all of which must hold. ``file_source`` names the source of plain files."""

    source_id: str | None = None
    extension: str | None = None
    extensions: tuple[str, ...] = ()
    category: str | None = None
    directory: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    file_source: str | None = "files"

    def __post_init__(self):
        for group in ((self.extension,) if self.extension else (), tuple(self.extensions)):
            if len(group) > 64:
                raise ValueError("at most 64 extensions")
            for e in group:
                if not isinstance(e, str) or not e.startswith(".") or len(e) > 24 or set(e) & set("/\\%*"):
                    raise ValueError("an extension starts with a dot and is no path or pattern")
        if self.category is not None and self.category not in CATEGORIES:
            raise ValueError("unknown file category")
        if self.modified_after and self.modified_before and nanoseconds(self.modified_after) >= nanoseconds(self.modified_before):
            raise ValueError("modified_after must be before modified_before")
        for size in (self.min_size, self.max_size):
            if size is not None and (isinstance(size, bool) or not isinstance(size, int) or size < 0):
                raise ValueError("sizes are non-negative integers")
        if self.min_size is not None and self.max_size is not None and self.min_size > self.max_size:
            raise ValueError("min_size is above max_size")

    def apply(self, documents: DataFrame) -> DataFrame:
        tests: list[Column] = []
        c = F.col
        if self.source_id:
            tests.append(c("source_id") == self.source_id)
        if self.extension:
            tests.append(c("extension") == self.extension.lower())
        if self.extensions:
            tests.append(c("extension").isin(sorted({e.lower() for e in self.extensions})))
        if self.category:
            tests.append(c("extension").isin(sorted(CATEGORIES[self.category])))
        if self.directory:
            top = self.directory.rstrip("/")
            tests.append((c("path") == top) | c("path").startswith(top + "/"))
        if self.modified_after:
            tests.append(c("mtime_ns") >= nanoseconds(self.modified_after))
        if self.modified_before:
            tests.append(c("mtime_ns") < nanoseconds(self.modified_before))
        if self.min_size is not None:
            tests.append(c("size") >= self.min_size)
        if self.max_size is not None:
            tests.append(c("size") <= self.max_size)
        files_only = (self.category, self.directory, self.modified_after, self.modified_before)
        if self.file_source and (any(files_only) or self.min_size is not None or self.max_size is not None):
            tests.append(c("source_id") == self.file_source)
        for t in tests:
            documents = documents.where(t)
        return documents


def check_request(query: str, mode: str, limit: int, sort: str = "relevance") -> int:
    """The limit to use; raises if the request is not one."""
    if mode not in ("files", "keyword", "semantic", "hybrid"):
        raise ValueError("unknown mode")
    if not isinstance(query, str) or not query.strip() or len(query) > 1000:
        raise ValueError("a query has 1 to 1000 characters")
    if sort not in SORTS:
        raise ValueError("unknown sort")
    return max(1, min(int(limit), 100))


def keyword_scores(rows: DataFrame, query: str, scope: DataFrame | None = None, text: str = "text", shown: list[str] | None = None) -> DataFrame:
    """Rows in which any phrase of the query occurs, with ``score`` (BM25, smaller is better).

    Corpus statistics come from ``rows``; ``scope`` (default: rows) is what is searched. One pass each. With ``shown``, the columns to keep,
    rows that are dear to make are made once: their counts are written beside these columns, without the texts, and both passes read that.
    """
    phrases = query_phrases(query)
    made = [f"__tf{i}" for i in range(len(phrases))]

    def counted(df):
        df = df.withColumn("__tokens", index_tokens(F.col(text)))
        df = df.withColumns({m: phrase_count(F.col("__tokens"), p) for m, p in zip(made, phrases, strict=True)})
        return df.withColumn("__length", F.size("__tokens")).drop("__tokens")

    if shown is not None and scope is None:
        path = f"{work_folder(rows.sparkSession)}/counted-{uuid.uuid4().hex}"
        counted(rows).select(*shown, "__length", *made).write.parquet(path)
        whole = found = rows.sparkSession.read.parquet(path)
    else:
        whole, found = counted(rows.select(text)), counted(rows if scope is None else scope)
    stats = whole.agg(F.count("*").alias("__rows"), F.avg("__length").alias("__average"), *[F.count_if(F.col(m) > 0).alias(f"{m}_rows") for m in made])
    hit = F.lit(False)
    for m in made:
        hit = hit | (F.col(m) > 0)
    found = found.where(hit).join(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for m in made:
        score = score + bm25_term(F.col(m), F.col(f"{m}_rows"), F.col("__rows"), F.col("__length"), F.col("__average"))
    return found.withColumn("score", score).drop("__length", "__rows", "__average", *made, *[f"{m}_rows" for m in made])


def ordering(sort: str, last: Column, score: str = "score") -> list[Column]:
    """Sort columns of a keyword page; ``last`` breaks ties."""
    lead = {"relevance": [], "modified_desc": [F.desc("mtime_ns")], "modified_asc": [F.asc("mtime_ns")], "name": [fold_ascii(F.col("name"))]}[sort]
    return [*lead, F.round(score, 9), last]


def keyword_search(documents: DataFrame, query: str, limit: int = 20, filters: Filters | None = None, sort: str = "relevance", key: str = "doc_id") -> DataFrame:
    limit = check_request(query, "keyword", limit, sort)
    scope = filters.apply(documents) if filters else documents
    return keyword_scores(documents, query, scope).orderBy(*ordering(sort, F.col(key))).limit(limit)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", tokens: Callable[[Column], Column] = index_tokens) -> DataFrame:
    """``term, key, tf, positions, length``: the inverted index, for many queries or to be written once.

    A row's tokens are together, so its postings are made where it lies: a batch's tokens are sorted by row and term at once, without a shuffle.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            codes, row = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.lexsort((codes, row))  # stable: places stay ascending
            codes, row, place = codes[order], row[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
            edges = np.append(first, len(codes))
            for at in range(0, len(first), 50_000):
                own, cut = first[at : at + 50_000], edges[at : at + 50_001]
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.dictionary.take(pa.array(codes[own])),
                        batch.column(0).take(pa.array(row[own])),
                        pa.array(lengths[row[own]].astype(np.int32)),
                        pa.array(np.diff(cut)),
                        pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(place[cut[0] : cut[-1]])),
                    ],
                    names=["term", "k", "length", "tf", "positions"],
                )

    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("k"), tokens(F.col(text)).alias("t"))
    return rows.mapInArrow(run, f"term string, k {kind}, length int, tf long, positions array<int>").withColumnRenamed("k", key)


def batch_keyword(index: DataFrame, lengths: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """Top ``limit`` rows for each query (query_id, term) over an index; single-term phrases.

    ``lengths``: key, length of every row. Query terms meet the index by a join on the term; the
    number of rows per term comes from the index itself.
    """
    stats = lengths.agg(F.count("*").alias("rows"), F.avg("length").alias("average"))
    wanted = queries.select("query_id", "term").distinct()
    hits = index.join(wanted.select("term").distinct(), "term", "left_semi")
    per_term = hits.groupBy("term").agg(F.count("*").alias("with"))
    scored = hits.join(per_term, "term").join(wanted, "term").join(F.broadcast(stats))
    scored = scored.withColumn("part", bm25_term(F.col("tf"), F.col("with"), F.col("rows"), F.col("length"), F.col("average")))
    total = scored.groupBy("query_id", key).agg(F.sum("part").alias("score"))
    return ranked(total, F.round("score", 9), key, "query_id").where(F.col("rank") < limit)


def filename_search(documents: DataFrame, query: str, limit: int = 20, filters: Filters | None = None, sort: str = "relevance", key: str = "doc_id") -> DataFrame:
    """Paths that hold the query (A-Z as a-z); a file of that very name comes first."""
    limit = check_request(query, "files", limit, sort)
    found = (filters.apply(documents) if filters else documents).where(fold_ascii(F.col("path")).contains(fold_ascii(F.lit(query))))
    lead = {
        "relevance": [F.when(fold_ascii(F.col("name")) == fold_ascii(F.lit(query)), 0).otherwise(1)],
        "modified_desc": [F.desc("mtime_ns")],
        "modified_asc": [F.asc("mtime_ns")],
        "name": [fold_ascii(F.col("name"))],
    }[sort]
    return found.orderBy(*lead, key).limit(limit)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine in double precision; a zero vector is at distance 1."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    wanted = F.array(*[F.lit(float(x)) for x in q])
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, wanted, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((size == 0) | (F.lit(norm) == 0), F.lit(1.0)).otherwise(1 - dot / (size * norm))


def check_vectors(vectors: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Only vectors of ``dim`` finite components."""
    v = F.col(embedding)
    return vectors.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def nearest(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """The exact ``limit`` nearest: filter, score, top-k; ties by key."""
    scope = vectors if where is None else vectors.where(where)
    scored = scope.select(key, F.round(cosine_distance(F.col(embedding), query), 6).alias("distance"))
    return scored.orderBy("distance", key).limit(limit)


def nearest_batch(vectors: DataFrame, queries: np.ndarray, limit: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_no, key, distance, rank`` for many queries at once (a bounded matrix, sent with the task).

    Every Arrow batch is scored as one matrix product and hands on its own top rows per query; the
    final ranking sees those only.
    """
    q = np.asarray(queries, np.float64)
    norm = np.sqrt((q * q).sum(1))
    q = q / np.where(norm == 0, 1, norm)[:, None]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            size = np.sqrt((v * v).sum(1))
            d = np.round(1 - q @ (v / np.where(size == 0, 1, size)[:, None]).T, 6) + 0.0
            k = min(limit, len(ids))
            for i, row in enumerate(d):
                edge = np.partition(row, k - 1)[k - 1]
                pick = np.flatnonzero(row <= edge)
                pick = pick[np.lexsort((ids[pick], row[pick]))][:k]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(pick), pa.int32()), pa.array(ids[pick]), pa.array(row[pick])], names=["query_no", "k", "distance"])

    rows = vectors.select(F.col(key).cast("long").alias("k"), embedding)
    part = rows.mapInArrow(run, "query_no int, k long, distance double")
    out = ranked(part, F.col("distance"), "k", "query_no").where(F.col("rank") < limit)
    return out.withColumnRenamed("k", key)


def ranked(rows: DataFrame, order: Column, key: str, *by: str) -> DataFrame:
    """Adds ``rank`` from 0 by ``order`` then ``key``, for each group of ``by`` if given."""
    window = Window.partitionBy(*by).orderBy(order, key) if by else Window.orderBy(order, key)
    return rows.withColumn("rank", F.row_number().over(window) - 1)


def fused(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank): ``key, score, matches``."""
    parts = [df.select(key, (F.lit(1.0) / (RANK_BASE + F.col("rank"))).alias("part"), F.lit(name).alias("match")) for name, df in lists.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("match")).alias("matches"))


def exact_ranks(ordered: DataFrame, limit: int, key: str, lists: int) -> DataFrame:
    """``name, key, rank``: exact ranks in their lists of every row that the first ``limit`` fused rows can hold.

    ``ordered``: name, key, value (smaller is better; ties by key). The best ``limit`` of one list alone score at least 1 / (base + limit - 1);
    a row behind place ``lists * (base + limit)`` in all lists scores less. So each list's first rows are candidates, and what a
    candidate of one list is in the others is counted. On the driver: candidates only, at most ``lists ** 2 * (base + limit)``.
    """
    spark, most = ordered.sparkSession, lists * (RANK_BASE + limit)
    place = F.row_number().over(Window.partitionBy("name").orderBy("value", key))
    top = [(r["name"], r[key], r["value"], r["place"] - 1) for r in ordered.withColumn("place", place).where(F.col("place") <= most).collect()]
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField(key, ordered.schema[key].dataType), T.StructField("rank", T.LongType())])
    found = [(n, k, r) for n, k, _, r in top]
    cut = {n for n, _, _, r in top if r == most - 1}  # lists that go on behind the candidates
    wanted = sorted({k for _, k, _, _ in top})
    if cut and wanted:
        have = {(n, k) for n, k, _, _ in top}
        rest = [(r["name"], r[key], r["value"]) for r in ordered.where(F.col("name").isin(sorted(cut)) & F.col(key).isin(wanted)).collect()]
        rest = sorted((n, v, k) for n, k, v in rest if (n, k) not in have)
        if rest:
            by = {n: ([v for m, v, _ in rest if m == n], [k for m, _, k in rest if m == n]) for n in {n for n, _, _ in rest}}

            def before(batches):
                for batch in batches:
                    names = np.array(batch.column(0).to_pylist(), object)
                    for name, (values, keys) in by.items():
                        here = np.flatnonzero(names == name)
                        if len(here):
                            all_values = np.concatenate([batch.column(2).to_numpy()[here], values])
                            all_keys = np.concatenate([np.array(batch.column(1).to_pylist())[here], keys])
                            rank = np.empty(len(all_values), np.int64)
                            rank[np.lexsort((all_keys, all_values))] = np.arange(len(all_values))
                            counts = rank[len(here) :] - np.arange(len(values))  # less the candidates before it; itself comes last of equals or not at all
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(range(len(values)), pa.int32()), pa.array(counts)], names=["name", "i", "n"])

            ordered_rows = ordered.where(F.col("name").isin(sorted(by))).select("name", key, "value").join(F.broadcast(spark.createDataFrame([(n, k) for n, _, k in rest], T.StructType(schema.fields[:2]))), ["name", key], "left_anti")
            counted = ordered_rows.mapInArrow(before, "name string, i int, n long").groupBy("name", "i").agg(F.sum("n").alias("n")).collect()
            found += [(r["name"], by[r["name"]][1][r["i"]], r["n"] + r["i"]) for r in counted]
    return spark.createDataFrame(found, schema)


def fused_top(lists: dict[str, DataFrame], limit: int, key: str) -> DataFrame:
    """The first ``limit`` rows of the whole lists fused by rank: ``key, score, matches``. ``lists``: (key, value), the smallest value first."""
    whole = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("name"), key, F.col("value").cast("double").alias("value"))
        whole = part if whole is None else whole.unionByName(part)
    ranks = exact_ranks(whole, limit, key, len(lists))
    return fused({n: ranks.where(F.col("name") == n) for n in lists}, key).orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def best_of(hits: DataFrame, document: str, value: str, key: str, smallest: bool = True) -> DataFrame:
    """``document, key, value`` of each document's best hit, ties by key: an aggregate, so a document of very many hits is reduced where they lie."""
    order = F.struct((F.col(value) if smallest else -F.col(value)).alias("v"), F.col(key).alias("k"))
    best = hits.groupBy(document).agg(F.min(order).alias("b"))
    return best.select(document, F.col("b.k").alias(key), (F.col("b.v") if smallest else -F.col("b.v")).alias(value))


def whole_ranks(ordered: DataFrame, key: str) -> DataFrame:
    """``name, key, rank`` (from 0, by value then key) of every row of every list, whatever their length.

    One sort by range over all lists; a row's rank is its place in its partition and the counts of those before. The driver sees nothing.
    """
    spark = ordered.sparkSession
    path = f"{work_folder(spark)}/ranks-{uuid.uuid4().hex}"
    order = ["name", "value", key]
    ordered.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    counts = held.groupBy("name", "__part").agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("name").orderBy("__part")) - F.col("n") - F.col("first")
    return held.join(counts.select("name", "__part", before.alias("shift")), ["name", "__part"]).select("name", key, (F.col("__id") + F.col("shift")).alias("rank"))


def fused_documents(lists: dict[str, DataFrame], limit: int, key: str, document: str) -> DataFrame:
    """The first ``limit`` documents by their best chunk in the fused lists (key, document, value): ``document, key, score, matches``.

    Ranks count chunks. The first few chunks of the fused list are ranked by candidates; only where they
    belong to too few documents, as one document may have any number of chunks, all ranks are made, by one distributed sort.
    """
    of, narrow, whole = None, {}, None
    for name, df in lists.items():
        part = df.select(key, document)
        of = part if of is None else of.unionByName(part)
        narrow[name] = df.select(key, "value")
        own = df.select(F.lit(name).alias("name"), key, F.col("value").cast("double").alias("value"))
        whole = own if whole is None else whole.unionByName(own)
    size = max(128, 5 * limit)
    hits = fused_top(narrow, size, key)
    found = [tuple(r) for r in hits.join(of.distinct(), key).select(document, key, "score", "matches").collect()]  # at most ``size``
    if len(found) >= size and len({r[0] for r in found}) < limit:
        ranks = whole_ranks(whole, key)
        hits = fused({n: ranks.where(F.col("name") == n) for n in lists}, key).withColumn("score", F.round("score", 9)).join(of.distinct(), key)
        best = best_of(hits, document, "score", key, smallest=False)
        page = best.orderBy(F.desc("score"), key).limit(limit)
        return page.join(hits.select(key, "matches"), key).select(document, key, "score", "matches")
    best: dict = {}
    for r in sorted(found, key=lambda r: (-round(r[2], 9), r[1])):
        best.setdefault(r[0], r)
    fields = [lists[next(iter(lists))].schema[document], of.schema[key], hits.schema["score"], hits.schema["matches"]]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip((document, key, "score", "matches"), fields, strict=True)])
    return hits.sparkSession.createDataFrame(list(best.values())[:limit], schema)


def hybrid_search(
    documents: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, limit: int = 20, filters: Filters | None = None, key: str = "doc_id", vector_key: str = "vec_id", words: DataFrame | None = None
) -> DataFrame:
    """Keyword and vector lists fused by rank, each whole; without a vector the keyword list alone.

    ``words`` (key, score): the keyword list of an index; by default it is scored from the texts.
    """
    limit = check_request(query, "hybrid", limit)
    scope = filters.apply(documents) if filters else documents
    if words is None:
        words = keyword_scores(documents, query, scope)
    elif filters:
        words = words.join(scope.select(key), key, "left_semi")
    lists = {"keyword": words.select(key, F.round("score", 9).alias("value"))}
    if vector is not None:
        eligible = vectors.join(scope.select(F.col(key).alias(vector_key)), vector_key, "left_semi")
        lists["semantic"] = eligible.select(F.col(vector_key).alias(key), F.round(cosine_distance(F.col("embedding"), vector), 6).alias("value"))
    return fused_top(lists, limit, key)


def exact_names_first(results: DataFrame, documents: DataFrame, query: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Files of the very name before all else: ``key, score, exact``, each document once."""
    exact = documents.where(fold_ascii(F.col("name")) == fold_ascii(F.lit(query))).select(key, F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    rest = results.select(key, "score", F.lit(False).alias("exact")).join(exact, key, "left_anti")
    return exact.unionByName(rest).orderBy(F.desc("exact"), F.desc(F.round("score", 9)), key).limit(limit)


def best_chunk(hits: DataFrame, document: str, order: list[Column]) -> DataFrame:
    """The first hit of each document."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where("__n = 1").drop("__n")


def content_digest(chunks: DataFrame, document: str = "doc_id") -> DataFrame:
    """SHA-256 over the chunk hashes of each document in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "hash")))
    return chunks.groupBy(document).agg(F.sha2(F.concat_ws("", F.transform(parts, lambda x: x["hash"])).cast("binary"), 256).alias("digest"))


def fold(hits: DataFrame, digest: Column, key: str, order: list[Column], foldable: Column | None = None) -> DataFrame:
    """One row per digest: the first hit, with the others' keys as ``other_locations``.

    Rows that are not foldable (stale or not ready) stay alone. Groups are of one page of hits.
    """
    group = digest if foldable is None else F.when(foldable, digest).otherwise(F.concat(F.lit("only:"), F.col(key).cast("string")))
    window = Window.partitionBy(group).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = hits.withColumn("__n", F.row_number().over(window)).withColumn("__all", F.collect_list(key).over(whole))
    return marked.where("__n = 1").withColumn("other_locations", F.expr("slice(__all, 2, greatest(size(__all) - 1, 0))")).drop("__n", "__all")


def fold_all(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """Every row with its group's representative: ``key, representative, others``.

    Groups of equal digest are of any size, so they stay rows and are never gathered; the smallest key represents.
    """
    marked = rows.select(key, digest.alias("digest"))
    groups = marked.groupBy("digest").agg(F.min(key).alias("representative"), (F.count("*") - 1).alias("others"))
    return marked.join(groups, "digest").select(key, "representative", "others")


def shown(hits: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with staleness, revision and citation; their documents are joined to them, broadcast if the planner finds the hits small."""
    d = documents.join(hits, key)
    stale = F.when(F.col("kind") == "row", F.lit(True)).otherwise((F.col("size") != F.col("indexed_size")) | (F.col("mtime_ns") != F.col("indexed_mtime_ns")))
    revision = F.coalesce(F.col("version"), F.concat_ws(":", "mtime_ns", "size"))
    d = d.withColumns({"stale": stale, "revision": revision})
    return d.withColumn("citation", F.struct("source_id", key, "path", "locator", "indexed_at", "revision", "stale"))
