"""Reading evidence: chunk ranks, neighbours, pages, coverage, diagnosis and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.text import index_tokens, phrase_count, query_phrases

STATUSES = ("ready", "partial", "unsupported", "encrypted", "error", "pending", "budget", "metadata")


def chunk_ranks(chunks: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("ordinal", "chunk_id")) -> DataFrame:
    """Adds ``rank``: how many chunks of the document come before."""
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1)


def neighbours(chunks: DataFrame, anchors: DataFrame, before: int = 1, after: int = 2, document: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """Chunks around each anchor (document, key), with ``anchor`` and ``distance``."""
    if not 0 <= before <= 5 or not 0 <= after <= 10:
        raise ValueError("before is 0 to 5, after 0 to 10")
    placed = chunk_ranks(chunks.join(anchors.select(document).distinct(), document, "left_semi"), document)
    at = placed.join(anchors.select(document, key), [document, key]).select(document, F.col(key).alias("anchor"), F.col("rank").alias("at"))
    near = placed.join(at, document).where(F.col("rank").between(F.col("at") - before, F.col("at") + after))
    return near.withColumn("distance", F.col("rank") - F.col("at")).drop("at")


def fetch_page(chunks: DataFrame, document_id, offset: int = 0, limit: int = 5, document: str = "doc_id") -> DataFrame:
    """A page of a document's chunks, with ``next_offset`` (null on the last page)."""
    limit, offset = max(1, min(int(limit), 20)), max(0, int(offset))
    placed = chunk_ranks(chunks.where(F.col(document) == document_id), document)
    total = F.count("*").over(Window.partitionBy(document))
    more = F.when(total > offset + limit, F.lit(offset + limit))
    return placed.withColumn("next_offset", more).where(F.col("rank").between(offset, offset + limit - 1))


def status_counts(documents: DataFrame, by: tuple[str, ...] = ("source_id", "status")) -> DataFrame:
    return documents.groupBy(*by).agg(F.count("*").alias("n"))


def coverage(chunks: DataFrame, embeddings: DataFrame, hash_column: str = "hash") -> DataFrame:
    """One row: all chunks, eligible ones, and eligible ones whose hash has a vector."""
    known = embeddings.select(hash_column).distinct().withColumn("__known", F.lit(True))
    joined = chunks.join(known, hash_column, "left")
    return joined.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("semantic")).alias("eligible"),
        F.count_if(F.col("semantic") & F.coalesce("__known", F.lit(False))).alias("embedded"),
    )


def source_states(documents: DataFrame) -> DataFrame:
    """For each source a map of status to count and the latest indexing time."""
    each = documents.groupBy("source_id", "status").agg(F.count("*").alias("n"), F.max("indexed_at").alias("at"))
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    return each.groupBy("source_id").agg(states.alias("states"), F.max("at").alias("indexed_at"))


def directory_counts(documents: DataFrame, directory: str) -> DataFrame:
    top = directory.rstrip("/")
    return documents.where((F.col("path") == top) | F.col("path").startswith(top + "/")).groupBy("status").agg(F.count("*").alias("n"))


def queue_metrics(work: DataFrame, now: float) -> DataFrame:
    """Counts of a work queue (available_at, attempts, priority) and its next retry."""
    later = F.col("available_at") > now
    return work.agg(
        F.count("*").alias("queued"),
        F.count_if(F.col("attempts") > 0).alias("retrying"),
        F.count_if(F.col("priority") > 0).alias("urgent"),
        F.count_if(~later).alias("due"),
        F.min(F.when(F.col("available_at") > 0, F.col("available_at"))).alias("earliest"),
        F.min(F.when(later, F.col("available_at"))).alias("next_retry"),
    )


def fair_selection(work: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """``size`` rows: a quarter is kept for the oldest normal work, the rest goes to urgent work first."""
    quota = max(1, size // 4)
    normal, urgent = work.where("priority <= 0"), work.where("priority > 0")
    by_turn = [F.desc("priority"), F.col("available_at"), F.col(key)]
    # top rows of each kind only, never the whole queue in a task
    oldest = normal.orderBy("available_at", key).limit(quota)
    rest = normal.orderBy(*by_turn).limit(size + quota).join(oldest.select(key), key, "left_anti").select(work.columns)
    turns = [oldest, urgent.orderBy(*by_turn).limit(size), rest]
    whole = turns[0].withColumn("__turn", F.lit(0))
    for n, more in enumerate(turns[1:], 1):
        whole = whole.unionByName(more.withColumn("__turn", F.lit(n)))
    return whole.orderBy("__turn", *by_turn).limit(size).drop("__turn")


def retry_delay(attempts: Column, changed: Column, interval: float) -> Column:
    """Seconds to the next try: half a second if the file changed while read, else doubling to an hour."""
    return F.when(changed, F.lit(0.5)).otherwise(F.least(F.lit(3600.0), F.greatest(F.lit(5.0), F.lit(float(interval))) * F.pow(F.lit(2.0), F.least(attempts, F.lit(4)))))


def sync_backoff(retries: Column, interval: float) -> Column:
    return F.least(F.lit(3600.0), F.lit(float(interval)) * F.pow(F.lit(2.0), F.least(retries, F.lit(6)) - 1))


# The decision ladder: the first code whose condition holds. Columns come from a snapshot of the paths
# asked for, joined to the indexed documents.
def diagnose(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``path, code`` for paths with their present state.

    ``requests``: path, in_scope, exists, readable, is_directory, size, mtime_ns, identity,
    content_allowed. ``documents``: path, status, size, mtime_ns, identity.
    """
    d = documents.select("path", F.lit(True).alias("known"), F.col("status"), F.col("size").alias("d_size"), F.col("mtime_ns").alias("d_mtime"), F.col("identity").alias("d_identity"))
    j = requests.join(d, "path", "left")
    by_status = {"pending": "content_pending", "error": "extraction_failed", "budget": "resource_or_file_limit", "unsupported": "unsupported_content", "partial": "partial_content", "encrypted": "encrypted_document"}
    ladder = [
        (~F.col("in_scope"), "excluded_or_outside_scope"),
        (~F.col("exists"), "missing_or_moved"),
        (~F.col("readable"), "permission_denied_or_unavailable"),
        (F.col("is_directory"), "directory_coverage"),
        (F.col("known").isNull(), "not_discovered"),
        (F.col("d_identity").isNull(), "legacy_identity_unverified"),
        (F.col("d_identity") != F.col("identity"), "replaced_file"),
        ((F.col("d_size") != F.col("size")) | (F.col("d_mtime") != F.col("mtime_ns")), "stale"),
        (~F.col("content_allowed"), "content_excluded"),
        *[(F.col("status") == s, code) for s, code in by_status.items()],
    ]
    code = F.when(ladder[0][0], ladder[0][1])
    for test, name in ladder[1:]:
        code = code.when(test, name)
    return j.select("path", code.otherwise("ready").alias("code"))


# What a user can do about each code.
ACTIONS = {
    "excluded_or_outside_scope": ["review_scope"],
    "missing_or_moved": ["search_filename"],
    "permission_denied_or_unavailable": ["check_source_access"],
    "directory_coverage": ["prioritize_path", "review_scope"],
    "not_discovered": ["prioritize_path"],
    "legacy_identity_unverified": ["refresh_path"],
    "replaced_file": ["refresh_path"],
    "stale": ["refresh_path"],
    "content_excluded": ["review_content_scope"],
    "content_pending": ["refresh_path", "review_limits"],
    "extraction_failed": ["refresh_path", "review_limits"],
    "resource_or_file_limit": ["refresh_path", "review_limits"],
    "unsupported_content": ["review_format_support"],
    "partial_content": ["refresh_path", "review_limits"],
    "encrypted_document": ["unlock_source_then_refresh"],
    "ready": ["fetch"],
}


def with_actions(diagnosis: DataFrame) -> DataFrame:
    """Adds ``actions`` (a list) for the code."""
    return diagnosis.withColumn("actions", F.create_map(*[x for code, names in ACTIONS.items() for x in (F.lit(code), F.array(*map(F.lit, names)))])[F.col("code")])


def query_evidence(diagnosis: DataFrame, documents: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Adds ``keyword_match``, ``filename_match`` and ``query_assessment``: whether a ready path answers the query (else null).

    ``documents``: path, doc_id; ``chunks``: doc_id, text. Only chunks of ready paths are tokenized; statistics are not needed.
    """
    ready = diagnosis.where("code = 'ready'").select("path").distinct().join(documents.select("path", "doc_id"), "path")
    words, hit = index_tokens(F.col("text")), F.lit(False)
    for phrase in query_phrases(query):
        hit = hit | (phrase_count(F.col("__tokens"), phrase) > 0)
    held = chunks.join(ready, "doc_id", "left_semi").withColumn("__tokens", words)
    found = ready.join(held.where(hit).select("doc_id").distinct(), "doc_id", "left_semi").select("path").distinct().withColumn("__hit", F.lit(True))
    is_ready = F.col("code") == "ready"
    keyword = F.when(is_ready, F.coalesce("__hit", F.lit(False)))
    name = F.when(is_ready, F.contains(F.lower("path"), F.lower(F.lit(query))))
    told = F.when(keyword | name, "match").when(is_ready, "no_keyword_match_in_indexed_content")
    out = diagnosis.join(found, "path", "left")
    return out.withColumns({"keyword_match": keyword, "filename_match": name, "query_assessment": told}).drop("__hit")


def progress_state(facts: DataFrame) -> DataFrame:
    """Adds ``state`` to rows of facts about an index (all booleans or counts), first match wins."""
    complete = ~F.col("active_root") & (F.col("queued_directories") == 0) & (F.col("discovery_errors") == 0) & ~F.col("unavailable_root")
    state = (
        F.when(F.col("paused"), "paused")
        .when(F.col("held"), "waiting")
        .when((F.col("due") > 0) | ~complete & (F.col("discovery_errors") == 0) & ~F.col("unavailable_root"), "indexing")
        .when((F.col("errors") > 0) | (F.col("discovery_errors") > 0) | F.col("unavailable_root"), "needs_attention")
        .when(F.col("retrying") > 0, "waiting")
        .when(F.col("semantic") & ~F.col("model_ready"), "model_not_ready")
        .otherwise("up_to_date")
    )
    return facts.withColumns({"discovery_complete": complete, "state": state})


def recall(hits: DataFrame, relevant: DataFrame, cases: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """First relevant rank and recall of each case group.

    ``hits``: case_id, doc_id, rank; ``relevant``: case_id, doc_id; ``cases``: case_id, group.
    """
    first = hits.join(relevant, ["case_id", "doc_id"]).groupBy("case_id").agg(F.min("rank").alias("first"))
    joined = cases.join(first, "case_id", "left")
    found = [F.avg(F.coalesce(F.col("first") < k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in at]
    return joined.groupBy("group").agg(F.count("*").alias("cases"), *found, F.avg("first").alias("mean_first_rank"))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    return samples.groupBy(by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("most"))
