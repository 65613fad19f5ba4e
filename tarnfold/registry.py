"""The registered queries of the library and their SQL twins for DuckDB.

``_register`` puts a function and its SQL side by side; SQL is left out where it cannot say the same
(parsers, the sequential debounce). All queries run over their whole tables.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.text import FOLDED, row_text
from tarnfold.operators import chunking, evidence, maintain, schedule, search, sync, vectors
from tarnfold.operators.index import KeywordIndex
from tarnfold.operators.paths import PathIndex
from tarnfold.operators.segments import VectorSegments
from tarnfold.plans.folders import work_folder
from tarnfold.plans.parallel import spread
from tarnfold.plans.structured import Source, within_budget
from tarnfold.sources import files
from tarnfold.streaming import events as streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_TABLES = "region nation customer supplier part orders lineitem".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _register(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- structured queries -------------------------------------------------------------------------


def _structured(name: str, request: dict, sql: str, max_rows: int = 10_000) -> None:
    used = {request["table"], *(j["table"] for j in request.get("joins", []))}

    def run(spark, sf_dir):
        return Source({t: _table(spark, sf_dir, t) for t in used}, max_rows=max_rows).plan({"limit": max_rows, **request})

    _register(name, sql)(run)


def _order(*names, direction="asc"):
    return [{"column": n, "direction": direction} for n in names]


_structured(
    "sq_filter_eq_ne",
    {"table": "orders", "columns": ["o_orderkey", "o_orderstatus", "o_orderpriority"], "filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_orderpriority", "op": "ne", "value": "1-URGENT"}], "order_by": _order("o_orderkey")},
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' ORDER BY o_orderkey LIMIT 10000",
)
_structured(
    "sq_filter_range",
    {"table": "orders", "columns": ["o_orderkey", "o_totalprice"], "filters": [{"column": "o_totalprice", "op": "gte", "value": 1000.0}, {"column": "o_totalprice", "op": "lt", "value": 150000.0}, {"column": "o_orderkey", "op": "gt", "value": 10}, {"column": "o_orderkey", "op": "lte", "value": 9000}], "order_by": _order("o_orderkey")},
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderkey > 10 AND o_orderkey <= 9000 ORDER BY o_orderkey LIMIT 10000",
)
_structured(
    "sq_filter_between",
    {"table": "orders", "columns": ["o_orderkey", "o_custkey"], "filters": [{"column": "o_custkey", "op": "between", "value": [100, 200]}], "order_by": _order("o_orderkey")},
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200 ORDER BY o_orderkey LIMIT 10000",
)
_structured(
    "sq_filter_in_not_in",
    {"table": "part", "columns": ["p_partkey", "p_brand", "p_size"], "filters": [{"column": "p_size", "op": "in", "value": [1, 5, 9, 14, 23, 36, 45]}, {"column": "p_brand", "op": "not_in", "value": ["Brand#11", "Brand#45"]}], "order_by": _order("p_partkey")},
    "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14, 23, 36, 45) AND p_brand NOT IN ('Brand#11', 'Brand#45') ORDER BY p_partkey LIMIT 10000",
)
_structured(
    "sq_filter_contains",
    {"table": "part", "columns": ["p_partkey", "p_name"], "filters": [{"column": "p_name", "op": "contains", "value": "a"}], "order_by": _order("p_partkey")},
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') ORDER BY p_partkey LIMIT 10000",
)
_structured(
    "sq_filter_starts_with",
    {"table": "customer", "columns": ["c_custkey", "c_name"], "filters": [{"column": "c_name", "op": "starts_with", "value": "Customer#0000001"}], "order_by": _order("c_custkey")},
    "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_custkey LIMIT 10000",
)
_structured(
    "sq_conjunction",
    {
        "table": "lineitem",
        "columns": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"],
        "filters": [{"column": "l_quantity", "op": "lt", "value": 24}, {"column": "l_discount", "op": "between", "value": [0.02, 0.06]}, {"column": "l_returnflag", "op": "eq", "value": "R"}, {"column": "l_linestatus", "op": "in", "value": ["F", "O"]}],
        "order_by": _order("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
        "limit": 500,
    },
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag = 'R' AND l_linestatus IN ('F', 'O') ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 500",
)
_structured(
    "sq_join_inner_2",
    {
        "table": "customer",
        "columns": ["c_mktsegment"],
        "joins": [{"table": "orders", "left": "c_custkey", "right": "orders.o_custkey"}],
        "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "max", "column": "orders.o_totalprice", "alias": "largest"}],
        "group_by": ["c_mktsegment"],
        "order_by": _order("c_mktsegment"),
    },
    "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS largest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
_structured(
    "sq_join_inner_5",
    {
        "table": "lineitem",
        "columns": ["nation.n_name", "region.r_name"],
        "joins": [
            {"table": "orders", "left": "l_orderkey", "right": "orders.o_orderkey"},
            {"table": "customer", "left": "orders.o_custkey", "right": "customer.c_custkey"},
            {"table": "nation", "left": "customer.c_nationkey", "right": "nation.n_nationkey"},
            {"table": "region", "left": "nation.n_regionkey", "right": "region.r_regionkey"},
        ],
        "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "min", "column": "l_shipdate", "alias": "first_ship"}],
        "group_by": ["nation.n_name", "region.r_name"],
        "order_by": _order("n", direction="desc") + _order("nation.n_name"),
    },
    'SELECT n_name AS "nation.n_name", r_name AS "region.r_name", count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name',
)


@_register("sq_join_left", "SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, sum(toxic) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _sq_join_left(spark, sf_dir):
    source = Source({t: _table(spark, sf_dir, t) for t in ("documents", "labels")})
    return source.plan(
        {
            "table": "documents",
            "columns": ["lang"],
            "joins": [{"table": "labels", "left": "doc_id", "right": "labels.doc_id", "type": "left"}],
            "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "count", "column": "labels.doc_id", "alias": "labelled"}, {"function": "sum", "column": "labels.toxic", "alias": "toxic"}],
            "group_by": ["lang"],
            "limit": 200,
        }
    )


def _labelled(spark, sf_dir, filters):
    source = Source({t: _table(spark, sf_dir, t) for t in ("documents", "labels")}, max_rows=10_000)
    return source.plan({"table": "documents", "columns": ["doc_id", "labels.quality"], "joins": [{"table": "labels", "left": "doc_id", "right": "labels.doc_id", "type": "left"}], "filters": filters, "order_by": _order("doc_id"), "limit": 10_000})


_LABELLED = 'SELECT d.doc_id, quality AS "labels.quality" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {} ORDER BY d.doc_id LIMIT 10000'


@_register("sq_filter_null", _LABELLED.format("quality IS NULL"))
def _sq_filter_null(spark, sf_dir):
    return _labelled(spark, sf_dir, [{"column": "labels.quality", "op": "eq", "value": None}, {"column": "labels.quality", "op": "is_null"}])


@_register("sq_filter_not_null", _LABELLED.format("quality IS NOT NULL"))
def _sq_filter_not_null(spark, sf_dir):
    return _labelled(spark, sf_dir, [{"column": "labels.quality", "op": "ne", "value": None}, {"column": "labels.quality", "op": "not_null"}])


@_register("sq_not_in_nulls", _LABELLED.format("quality NOT IN (0, 7)"))
def _sq_not_in_nulls(spark, sf_dir):
    return _labelled(spark, sf_dir, [{"column": "labels.quality", "op": "not_in", "value": [0, 7]}])


_structured(
    "sq_agg_all",
    {
        "table": "lineitem",
        "columns": ["l_returnflag", "l_linestatus"],
        "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "count", "column": "l_shipdate", "alias": "dated"}, {"function": "sum", "column": "l_linenumber", "alias": "lines"}, {"function": "avg", "column": "l_linenumber", "alias": "mean_line"}, {"function": "min", "column": "l_extendedprice", "alias": "lowest"}, {"function": "max", "column": "l_extendedprice", "alias": "highest"}],
        "group_by": ["l_returnflag", "l_linestatus"],
    },
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_shipdate) AS dated, CAST(sum(l_linenumber) AS BIGINT) AS lines, avg(l_linenumber) AS mean_line, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_structured(
    "sq_agg_global",
    {"table": "orders", "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "min", "column": "o_orderdate", "alias": "first_day"}, {"function": "max", "column": "o_totalprice", "alias": "largest"}]},
    "SELECT count(*) AS n, min(o_orderdate) AS first_day, max(o_totalprice) AS largest FROM orders",
)
_structured(
    "sq_group_distinct",
    {"table": "orders", "columns": ["o_orderstatus", "o_orderpriority"], "group_by": ["o_orderstatus", "o_orderpriority"], "order_by": _order("o_orderstatus", "o_orderpriority")},
    "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
)
_structured(
    "sq_order_by_alias",
    {"table": "orders", "columns": ["o_custkey"], "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "max", "column": "o_totalprice", "alias": "largest"}], "group_by": ["o_custkey"], "order_by": _order("n", direction="desc") + _order("o_custkey"), "limit": 100},
    "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 100",
)
_structured(
    "sq_page_offset",
    {"table": "orders", "columns": ["o_orderkey", "o_totalprice"], "order_by": _order("o_totalprice", direction="desc") + _order("o_orderkey"), "limit": 50, "offset": 125},
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 125",
)
_PAGE = {"table": "orders", "columns": ["o_orderkey", "o_orderpriority"], "order_by": _order("o_orderkey"), "limit": 40}


@_register("sq_truncated_flag", "SELECT least(count(*), 40) AS shown, count(*) > 40 AS truncated FROM orders")
def _sq_truncated(spark, sf_dir):
    page = Source({"orders": _table(spark, sf_dir, "orders")}).plan(_PAGE, probe=True)
    return page.agg(F.least(F.count("*"), F.lit(40)).alias("shown"), (F.count("*") > 40).alias("truncated"))


@_register(
    "sq_char_budget",
    """WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS n,
         sum(length('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}')) OVER (ORDER BY o_orderkey) AS upto
       FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 41))
       SELECT o_orderkey, o_orderpriority FROM p WHERE n <= 40 AND upto <= 1000""",
)
def _sq_budget(spark, sf_dir):
    page = Source({"orders": _table(spark, sf_dir, "orders")}).plan(_PAGE, probe=True)
    return within_budget(page, 40, 1000, [F.col("__o0")]).where("__kept").select("o_orderkey", "o_orderpriority")


# ---- a corpus of the driver's documents ----------------------------------------------------------

_EXTENSIONS = (".txt", ".md", ".py", ".csv", ".json")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: source, path, name, extension, size, time."""
    d = _table(spark, sf_dir, "documents")
    extension = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), extension)
    rows = d.select(
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("source_id"),
        F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"),
        name.alias("name"),
        extension.alias("extension"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1_700_000_000_000_000_000) + F.col("doc_id") % 97 * F.lit(86_400_000_000_000)).alias("mtime_ns"),
    )
    return spread(rows)  # dealt out as what is asked of them: no text where none is


_FOLD = "text"
for _k, _v in FOLDED.items():
    _FOLD = f"replace({_FOLD}, '{_k}', '{_v}')"
_CORPUS = f"""corpus AS (SELECT doc_id, text, lang, source AS source_id, e AS extension, 'doc' || doc_id || e AS name,
    '/data/' || lang || '/' || source || '/doc' || doc_id || e AS path, CAST(strlen(text) AS BIGINT) AS size,
    1700000000000000000 + doc_id % 97 * 86400000000000 AS mtime_ns
  FROM (SELECT *, list_extract(['.txt', '.md', '.py', '.csv', '.json'], CAST(doc_id % 5 + 1 AS INT)) AS e FROM documents)),
tokens AS (SELECT doc_id, regexp_extract_all(lower({_FOLD}), '[a-z0-9]+') AS t FROM documents)"""


def _bm25_sql(terms: list[str], where: str = "TRUE") -> str:
    """CTEs up to ``hits``: doc_id, score of the corpus rows that match and pass ``where``."""
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS n{i}" for i in range(len(terms)))
    half, k1 = "CAST(0.5 AS DOUBLE)", "CAST(1.2 AS DOUBLE)"
    parts = []
    for i in range(len(terms)):
        odds = f"(rows_all - n{i} + {half}) / (n{i} + {half})"
        idf = f"(CASE WHEN ln({odds}) > 0 THEN ln({odds}) ELSE CAST(0.000001 AS DOUBLE) END)"
        parts.append(f"{idf} * tf{i} * CAST(2.2 AS DOUBLE) / (tf{i} + {k1} * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length_own / length_mean))")
    any_hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH {_CORPUS},
counted AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS length_own, {tf} FROM tokens),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS rows_all, avg(length_own) AS length_mean, {df} FROM counted),
hits AS (SELECT c.*, -({" + ".join(parts)}) AS score FROM counted, stats, corpus c WHERE c.doc_id = counted.doc_id AND ({any_hit}) AND ({where}))"""


_WORDS = ["the", "edition", "heen"]
_QUERY = " ".join(_WORDS)


def _rounded():
    return F.round("score", 6).alias("score")


_INDEXES: dict[tuple, KeywordIndex] = {}


def _indexed(spark, sf_dir, name: str, rows: Callable[[SparkSession, str], DataFrame], key: str) -> KeywordIndex:
    """The written index of a corpus: made by the first query that needs it, read by all others of the application while its table stays the same."""
    at = (spark.sparkContext.applicationId, name, _stamp(spark, f"{sf_dir}/{'documents' if name == 'documents' else 'conversations'}.parquet"))
    if at not in _INDEXES:
        _INDEXES[at] = KeywordIndex.build(rows(spark, sf_dir), f"{work_folder(spark)}/index-{name}-{uuid.uuid4().hex}", key)
    return _INDEXES[at]


def _stamp(spark, path: str) -> str:
    """A digest of a table's files: names, sizes and times."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    facts = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(facts).encode()).hexdigest()


def _documents_index(spark, sf_dir) -> KeywordIndex:
    return _indexed(spark, sf_dir, "documents", lambda s, d: corpus(s, d).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), "doc_id")


@_register("kw_bm25", _bm25_sql(_WORDS) + " SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), doc_id LIMIT 20")
def _kw_bm25(spark, sf_dir):
    return _documents_index(spark, sf_dir).search(_QUERY).select("doc_id", _rounded())


@_register("kw_bm25_all", _bm25_sql(_WORDS) + " SELECT doc_id, round(score, 6) AS score FROM hits")
def _kw_bm25_all(spark, sf_dir):
    """Scored from the texts, without an index."""
    return search.keyword_scores(corpus(spark, sf_dir), _QUERY).select("doc_id", _rounded())


_LIVE_SQL = "WITH live AS (SELECT * FROM documents WHERE doc_id % 11 <> 0), " + _bm25_sql(_WORDS).replace("FROM documents", "FROM live").removeprefix("WITH ")


def _changed_index(spark, sf_dir) -> KeywordIndex:
    """An index of two thirds of the documents, some with older texts, after the others came, the texts changed and some documents went."""
    rows, old = corpus(spark, sf_dir), F.col("doc_id") % 7 == 0
    first = rows.where("doc_id % 3 <> 0").withColumn("text", F.when(old, F.concat(F.lit("edition the edition "), F.upper("text"))).otherwise(F.col("text")))
    index = KeywordIndex.build(first, f"{work_folder(spark)}/changed-{uuid.uuid4().hex}")
    index = index.apply(rows.where((F.col("doc_id") % 3 == 0) | old))
    return index.apply(deleted=rows.where("doc_id % 11 = 0").select("doc_id"))


@_register("kw_incremental", _LIVE_SQL + " SELECT doc_id, round(score, 6) AS score FROM hits")
def _kw_incremental(spark, sf_dir):
    return _changed_index(spark, sf_dir).scores(_QUERY).select("doc_id", _rounded())


@_register("kw_compacted", _LIVE_SQL + " SELECT doc_id, path, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), doc_id LIMIT 20")
def _kw_compacted(spark, sf_dir):
    return _changed_index(spark, sf_dir).compact(ratio=0.01, most=1).search(_QUERY).select("doc_id", "path", _rounded())


_PHRASES = "the_edition of_the"


@_register(
    "kw_phrases",
    f"""WITH {_CORPUS}, grams AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS length_own, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tokens),
    counted AS (SELECT doc_id, length_own, CAST(len(list_filter(g, lambda x: x = 'the edition')) AS DOUBLE) AS tf0, CAST(len(list_filter(g, lambda x: x = 'of the')) AS DOUBLE) AS tf1 FROM grams),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length_own) AS mean, CAST(count(*) FILTER (WHERE tf0 > 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE tf1 > 0) AS DOUBLE) AS n1 FROM counted)
    SELECT doc_id, round(-(greatest(ln((n - n0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE)), CASE WHEN ln((n - n0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE)) > 0 THEN 0::DOUBLE ELSE 0.000001::DOUBLE END) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length_own / mean))
      + greatest(ln((n - n1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE)), CASE WHEN ln((n - n1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE)) > 0 THEN 0::DOUBLE ELSE 0.000001::DOUBLE END) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length_own / mean))), 6) AS score
    FROM counted, stats WHERE tf0 > 0 OR tf1 > 0""",
)
def _kw_phrases(spark, sf_dir):
    return _documents_index(spark, sf_dir).scores(_PHRASES).select("doc_id", _rounded())


_FILTERS = search.Filters(extensions=(".txt", ".md", ".csv"), category="document", directory="/data/en", modified_after="2023-11-20", modified_before="2024-02-01T00:00:00Z", min_size=200, max_size=20_000, file_source=None)
_FILTER_SQL = f"""extension IN ('.txt', '.md', '.csv') AND extension IN ('.pdf', '.docx', '.pptx', '.txt', '.md', '.markdown', '.rst', '.tex')
 AND (path = '/data/en' OR starts_with(path, '/data/en/')) AND mtime_ns >= {search.nanoseconds("2023-11-20")} AND mtime_ns < {search.nanoseconds("2024-02-01")} AND size >= 200 AND size <= 20000"""


@_register("kw_filtered", _bm25_sql(_WORDS, _FILTER_SQL) + " SELECT doc_id, path, size, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), doc_id LIMIT 20")
def _kw_filtered(spark, sf_dir):
    return _documents_index(spark, sf_dir).search(_QUERY, filters=_FILTERS).select("doc_id", "path", "size", _rounded())


@_register("kw_source", _bm25_sql(_WORDS, "source_id = 'src3' AND extension = '.py'") + " SELECT doc_id, source_id, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), doc_id LIMIT 20")
def _kw_source(spark, sf_dir):
    return _documents_index(spark, sf_dir).search(_QUERY, filters=search.Filters(source_id="src3", extension=".py")).select("doc_id", "source_id", _rounded())


for _sort, _by in (("modified_desc", "mtime_ns DESC, "), ("modified_asc", "mtime_ns, "), ("name", "lower(name), ")):

    @_register(f"kw_sorted_{_sort}", _bm25_sql(_WORDS) + f" SELECT doc_id, name, mtime_ns FROM hits ORDER BY {_by}round(hits.score, 9), doc_id LIMIT 50")
    def _kw_sorted(spark, sf_dir, sort=_sort):
        return _documents_index(spark, sf_dir).search(_QUERY, 50, sort=sort).select("doc_id", "name", "mtime_ns")


@_register("fn_substring", f"WITH {_CORPUS} SELECT doc_id, path FROM corpus WHERE contains(lower(path), lower('SRC1/doc1')) ORDER BY CASE WHEN lower(name) = lower('SRC1/doc1') THEN 0 ELSE 1 END, doc_id LIMIT 100")
def _fn_substring(spark, sf_dir):
    return search.filename_search(corpus(spark, sf_dir), "SRC1/doc1", 100).select("doc_id", "path")


@_register("fn_indexed", f"WITH {_CORPUS} SELECT doc_id, path FROM corpus WHERE doc_id % 11 <> 0 AND contains(lower(path), lower('SRC1/doc1')) ORDER BY CASE WHEN lower(name) = lower('SRC1/doc1') THEN 0 ELSE 1 END, doc_id LIMIT 100")
def _fn_indexed(spark, sf_dir):
    """By the path index, after half the documents moved to where they are and some went."""
    rows = corpus(spark, sf_dir).drop("text")
    index = PathIndex.build(rows.withColumn("path", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/old/src1/doc1/"), "name")).otherwise(F.col("path"))), f"{work_folder(spark)}/paths-{uuid.uuid4().hex}")
    index = index.apply(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 11 = 0").select("doc_id"))
    index = index.apply(deleted=rows.where("doc_id % 11 = 0").select("doc_id"))
    return index.search("SRC1/doc1", 100).select("doc_id", "path")


@_register("fn_exact_first", f"WITH {_CORPUS} SELECT doc_id, name FROM corpus WHERE contains(lower(path), 'doc5.txt') ORDER BY CASE WHEN lower(name) = 'doc5.txt' THEN 0 ELSE 1 END, doc_id LIMIT 20")
def _fn_exact_first(spark, sf_dir):
    return search.filename_search(corpus(spark, sf_dir), "DOC5.txt").select("doc_id", "name")


@_register("category_counts", f"WITH {_CORPUS} SELECT lang, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM corpus WHERE extension IN ('.json', '.jsonl', '.xml', '.csv', '.tsv', '.yaml', '.yml', '.toml', '.ini', '.conf', '.config', '.env') GROUP BY lang")
def _category_counts(spark, sf_dir):
    return search.Filters(category="data", file_source=None).apply(corpus(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# ---- chunks: the conversations' turns -------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(_table(spark, sf_dir, "conversations"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), (F.col("role") == "assistant").alias("semantic"))


_TURNS = "turns AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS ordinal, conv_id * 1000 + turn AS chunk_id, role, text, sha256(text) AS hash, role = 'assistant' AS semantic FROM conversations)"


@_register("doc_first_chunk", f"WITH {_TURNS} SELECT doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_id) AS n FROM turns) WHERE n = 1")
def _doc_first_chunk(spark, sf_dir):
    return search.best_chunk(turns(spark, sf_dir), "doc_id", [F.desc(F.char_length("text")), F.col("chunk_id")]).select("doc_id", "chunk_id")


@_register("content_digest", f"WITH {_TURNS} SELECT doc_id, sha256(string_agg(hash, '' ORDER BY ordinal, chunk_id)) AS digest FROM turns GROUP BY doc_id")
def _content_digest(spark, sf_dir):
    return search.content_digest(turns(spark, sf_dir))


@_register("fold_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, count(*) OVER (PARTITION BY text) - 1 AS others FROM documents")
def _fold_duplicates(spark, sf_dir):
    return search.fold_all(_table(spark, sf_dir, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")


@_register(
    "fold_page",
    _bm25_sql(_WORDS) + ", page AS (SELECT doc_id, text, row_number() OVER (ORDER BY round(hits.score, 9), doc_id) AS r FROM hits ORDER BY r LIMIT 100) SELECT arg_min(doc_id, r) AS doc_id, array_to_string(list(doc_id ORDER BY r)[2:], ',') AS other_locations FROM page GROUP BY text",
)
def _fold_page(spark, sf_dir):
    page = _documents_index(spark, sf_dir).search(_QUERY, 100)
    out = search.fold(page, F.col("digest"), "doc_id", [F.round("score", 9), F.col("doc_id")])
    return out.select("doc_id", F.array_join(F.transform("other_locations", lambda x: x.cast("string")), ",").alias("other_locations"))


@_register("anchor_rank", f"WITH {_TURNS} SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, chunk_id) - 1 AS rank FROM turns")
def _anchor_rank(spark, sf_dir):
    return evidence.chunk_ranks(turns(spark, sf_dir)).select("doc_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@_register(
    "ctx_neighbours",
    f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, chunk_id) - 1 AS rank FROM turns)
    SELECT a.chunk_id AS anchor, n.chunk_id, n.rank - a.rank AS distance FROM r a JOIN r n ON a.doc_id = n.doc_id AND n.rank BETWEEN a.rank - 1 AND a.rank + 2 WHERE a.role = 'assistant'""",
)
def _ctx_neighbours(spark, sf_dir):
    t = turns(spark, sf_dir)
    out = evidence.neighbours(t, t.where("semantic").select("doc_id", "chunk_id"), 1, 2)
    return out.select("anchor", "chunk_id", F.col("distance").cast("long").alias("distance"))


@_register(
    "fetch_page",
    f"""WITH {_TURNS}, r AS (SELECT *, row_number() OVER (ORDER BY ordinal, chunk_id) - 1 AS rank, count(*) OVER () AS total FROM turns WHERE doc_id = 3)
    SELECT chunk_id, rank, CASE WHEN total > 5 THEN 5 END AS next_offset FROM r WHERE rank BETWEEN 2 AND 4""",
)
def _fetch_page(spark, sf_dir):
    out = evidence.fetch_page(turns(spark, sf_dir), 3, 2, 3)
    return out.select("chunk_id", F.col("rank").cast("long").alias("rank"), F.col("next_offset").cast("int").alias("next_offset"))


# ---- vectors ---------------------------------------------------------------------------------------

_VECTOR = [round(float(x), 4) for x in np.sin(np.arange(64) * 0.7)]
_COSINE = "round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6)"
_VECTORS = f"vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, CAST({_VECTOR} AS DOUBLE[]) AS q FROM embeddings)"


@_register("vec_topk", f"WITH {_VECTORS} SELECT vec_id, {_COSINE} AS distance FROM vectors ORDER BY distance, vec_id LIMIT 20")
def _vec_topk(spark, sf_dir):
    return search.nearest(_table(spark, sf_dir, "embeddings"), _VECTOR, 20)


@_register("vec_topk_filtered", f"WITH {_VECTORS} SELECT vec_id, {_COSINE} AS distance FROM vectors WHERE label IN (2, 5) ORDER BY distance, vec_id LIMIT 20")
def _vec_topk_filtered(spark, sf_dir):
    return search.nearest(_table(spark, sf_dir, "embeddings"), _VECTOR, 20, where=F.col("label").isin(2, 5))


_MANY = np.round(np.sin(np.outer(np.arange(1, 9), np.arange(64)) * 0.37), 4)


@_register(
    "vec_topk_batch",
    f"""WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    wanted AS (SELECT unnest(range(8)) AS query_no, unnest(CAST({_MANY.tolist()} AS DOUBLE[][])) AS q),
    scored AS (SELECT query_no, vec_id, {_COSINE} AS distance FROM vectors, wanted),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY distance, vec_id) - 1 AS rank FROM scored)
    SELECT CAST(query_no AS INT) AS query_no, vec_id, distance, rank FROM placed WHERE rank < 10""",
)
def _vec_topk_batch(spark, sf_dir):
    out = search.nearest_batch(_table(spark, sf_dir, "embeddings"), _MANY, 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


def _cells(spark, sf_dir):
    """The embeddings in segments of two passes, their chunks, and every hundredth as queries."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").cast("string").alias("hash"), F.lit(True).alias("semantic"), "embedding")
    s = VectorSegments(spark, f"{work_folder(spark)}/cells-{uuid.uuid4().hex}")
    s.add(rows.where("chunk_id % 4 <> 0"), rows)
    s.add(rows, rows)
    return s, rows.select("chunk_id", "hash", "semantic"), rows.where("chunk_id % 100 = 0").select("chunk_id", "embedding")


def _asked(queries: DataFrame, size: int = 1000):
    """The queries' ids and vectors in blocks that the driver holds."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield [x[0] for x in block], np.array([x[1] for x in block])
            block = []
    if block:
        yield [x[0] for x in block], np.array([x[1] for x in block])


def _hits_of(spark, queries, search_block) -> DataFrame:
    out = None
    for ids, vectors in _asked(queries):
        names = spark.createDataFrame(list(enumerate(ids)), "query_no int, query_id long")
        part = search_block(vectors).join(F.broadcast(names), "query_no").select("query_id", F.col("chunk_id").alias("vec_id"), "distance", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank long") if out is None else out


_ALL_NEAREST = f"""WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    wanted AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE vec_id % 100 = 0),
    scored AS (SELECT query_id, vec_id, {_COSINE} AS distance FROM vectors, wanted),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) - 1 AS rank FROM scored)"""


@_register("vec_cells", _ALL_NEAREST + " SELECT query_id, vec_id, distance, rank FROM placed WHERE rank < 10")
def _vec_cells(spark, sf_dir):
    """The exact nearest of every hundredth vector, by the cells that may hold them."""
    s, chunks, queries = _cells(spark, sf_dir)
    return _hits_of(spark, queries, lambda q: s.search_batch(q, 10, chunks, certain=True))


@_register("vec_cells_recall", "SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, TRUE AS recalled FROM embeddings")
def _vec_cells_recall(spark, sf_dir):
    """Whether the nearest cells alone find 95 of 100 of the ten nearest of every hundredth vector."""
    s, chunks, queries = _cells(spark, sf_dir)
    near = _hits_of(spark, queries, lambda q: s.search_batch(q, 10, chunks))
    rows = _table(spark, sf_dir, "embeddings")
    exact = _hits_of(spark, queries, lambda q: search.nearest_batch(rows, q, 10).withColumnRenamed("vec_id", "chunk_id"))
    found = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.95 * F.count("*")).alias("recalled"))
    return found


_HYBRID = (
    _bm25_sql(_WORDS)
    + f""", {_VECTORS},
words AS (SELECT doc_id, row_number() OVER (ORDER BY round(hits.score, 9), doc_id) - 1 AS rank FROM hits),
near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COSINE}, vec_id) - 1 AS rank FROM vectors WHERE vec_id IN (SELECT doc_id FROM corpus)),
fused AS (SELECT doc_id, sum(CAST(1 AS DOUBLE) / (61 + rank)) AS score FROM (SELECT * FROM words UNION ALL SELECT * FROM near) GROUP BY doc_id)"""
)


@_register("hybrid_rrf", _HYBRID + " SELECT doc_id, round(score, 6) AS score FROM fused ORDER BY round(fused.score, 9) DESC, doc_id LIMIT 20")
def _hybrid_rrf(spark, sf_dir):
    index = _documents_index(spark, sf_dir)
    return search.hybrid_search(index.documents, _table(spark, sf_dir, "embeddings"), _QUERY, _VECTOR, words=index.scores(_QUERY)).select("doc_id", _rounded())


@_register(
    "hybrid_exact_prepend",
    _HYBRID
    + """, page AS (SELECT doc_id, score FROM fused ORDER BY round(fused.score, 9) DESC, doc_id LIMIT 20),
exact AS (SELECT doc_id FROM corpus WHERE lower(name) = 'doc7.py'), both_lists AS (SELECT doc_id, CAST(1 AS DOUBLE) AS score, TRUE AS exact FROM exact
UNION ALL SELECT doc_id, score, FALSE FROM page WHERE doc_id NOT IN (SELECT doc_id FROM exact))
SELECT doc_id, round(score, 6) AS score, exact FROM both_lists ORDER BY exact DESC, round(both_lists.score, 9) DESC, doc_id LIMIT 20""",
)
def _hybrid_exact(spark, sf_dir):
    index = _documents_index(spark, sf_dir)
    page = search.hybrid_search(index.documents, _table(spark, sf_dir, "embeddings"), _QUERY, _VECTOR, words=index.scores(_QUERY))
    return search.exact_names_first(page, index.documents, "Doc7.py", 20).select("doc_id", _rounded(), "exact")


@_register(
    "kw_batch",
    f"""WITH {_TURNS}, tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower({_FOLD}), '[a-z0-9]+')) AS term FROM turns),
    lens AS (SELECT chunk_id, CAST(len(regexp_extract_all(lower({_FOLD}), '[a-z0-9]+')) AS DOUBLE) AS length FROM turns),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean FROM lens),
    wanted AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower({_FOLD}), '[a-z0-9]+')) AS term FROM benchmark),
    post AS (SELECT term, chunk_id, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY term, chunk_id),
    with_term AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term),
    parts AS (SELECT query_id, chunk_id, -(CASE WHEN ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) > 0 THEN ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) ELSE CAST(0.000001 AS DOUBLE) END)
      * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean)) AS part
      FROM post JOIN with_term USING (term) JOIN wanted USING (term) JOIN lens USING (chunk_id), stats),
    scored AS (SELECT query_id, chunk_id, sum(part) AS score FROM parts GROUP BY query_id, chunk_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) - 1 AS rank FROM scored)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM placed WHERE rank < 5""",
)
def _kw_batch(spark, sf_dir):
    from tarnfold.functions.text import index_tokens

    index = _indexed(spark, sf_dir, "turns", turns, "chunk_id")
    wanted = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(index_tokens(F.col("text"))).alias("term"))
    out = index.batch(wanted, 5)
    return out.select("query_id", "chunk_id", _rounded(), F.col("rank").cast("long").alias("rank"))


# ---- status ---------------------------------------------------------------------------------------

_STATES = f"""{_CORPUS}, states AS (SELECT c.doc_id, c.source_id, c.path, c.size, c.mtime_ns, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'partial' ELSE 'ready' END AS status
  FROM corpus c LEFT JOIN labels l ON c.doc_id = l.doc_id)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with a status: unlabelled is pending, toxic error, poor partial, else ready."""
    labels = _table(spark, sf_dir, "labels")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "partial").otherwise("ready")
    return corpus(spark, sf_dir).drop("text").join(labels, "doc_id", "left").withColumn("status", status).withColumn("indexed_at", F.col("mtime_ns"))


@_register("coverage_status", f"WITH {_STATES} SELECT source_id, status, count(*) AS n FROM states GROUP BY source_id, status")
def _coverage_status(spark, sf_dir):
    return evidence.status_counts(states(spark, sf_dir))


@_register("directory_counts", f"WITH {_STATES} SELECT status, count(*) AS n FROM states WHERE starts_with(path, '/data/en/') GROUP BY status")
def _directory_counts(spark, sf_dir):
    return evidence.directory_counts(states(spark, sf_dir), "/data/en/")


@_register("source_states", f"WITH {_STATES}, e AS (SELECT source_id, status, count(*) AS n, max(mtime_ns) AS latest FROM states GROUP BY source_id, status) SELECT source_id, string_agg(status || '=' || n, ',' ORDER BY status) AS states, max(latest) AS indexed_at FROM e GROUP BY source_id")
def _source_states(spark, sf_dir):
    out = evidence.source_states(states(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("source_id", text.alias("states"), "indexed_at")


_WORK = "work AS (SELECT doc_id, doc_id % 50 AS available_at, CAST(doc_id % 3 AS INT) AS attempts, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS priority FROM documents)"


def _work(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") % 50).alias("available_at"), (F.col("doc_id") % 3).cast("int").alias("attempts"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("priority"))


@_register("queue_metrics", f"WITH {_WORK} SELECT count(*) AS queued, count(*) FILTER (WHERE attempts > 0) AS retrying, count(*) FILTER (WHERE priority > 0) AS urgent, count(*) FILTER (WHERE available_at <= 25) AS due, min(available_at) FILTER (WHERE available_at > 0) AS earliest, min(available_at) FILTER (WHERE available_at > 25) AS next_retry FROM work")
def _queue_metrics(spark, sf_dir):
    return evidence.queue_metrics(_work(spark, sf_dir), 25)


@_register(
    "fair_selection",
    f"""WITH {_WORK}, turn AS (SELECT *, CASE WHEN priority <= 0 AND row_number() OVER (PARTITION BY priority <= 0 ORDER BY available_at, doc_id) <= 8 THEN 0 WHEN priority > 0 THEN 1 ELSE 2 END AS turn FROM work)
    SELECT doc_id, priority FROM turn ORDER BY turn, priority DESC, available_at, doc_id LIMIT 32""",
)
def _fair_selection(spark, sf_dir):
    return evidence.fair_selection(_work(spark, sf_dir), 32).select("doc_id", "priority")


@_register("retry_delays", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(3600 AS DOUBLE), CAST(180 AS DOUBLE) * pow(CAST(2 AS DOUBLE), least(doc_id % 8, 4))) END AS retry, least(CAST(3600 AS DOUBLE), CAST(60 AS DOUBLE) * pow(CAST(2 AS DOUBLE), least(doc_id % 8, 6) - 1)) AS backoff FROM documents")
def _retry_delays(spark, sf_dir):
    d, n = _table(spark, sf_dir, "documents"), F.col("doc_id") % 8
    return d.select("doc_id", evidence.retry_delay(n, F.col("doc_id") % 11 == 0, 180).alias("retry"), evidence.sync_backoff(n, 60).alias("backoff"))


# ---- maintenance -------------------------------------------------------------------------------------



def _vectors_of_turns(spark, sf_dir):
    """Half of the turns' hashes have a vector, and some vectors have no turn."""
    t = turns(spark, sf_dir)
    have = t.where(F.col("chunk_id") % 2 == 0).select("hash").distinct().withColumn("model", F.lit("m1"))
    lone = _table(spark, sf_dir, "labels").select(F.sha2(F.concat(F.lit("lone"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("hash"), F.lit("m1").alias("model"))
    return have.unionByName(lone)


_HAVE = _TURNS + ", have AS (SELECT DISTINCT hash, 'm1' AS model FROM turns WHERE chunk_id % 2 = 0 UNION ALL SELECT sha256('lone' || doc_id), 'm1' FROM labels)"


@_register("embed_pending", f"WITH {_HAVE} SELECT hash, min(text) AS text FROM turns WHERE semantic AND hash NOT IN (SELECT hash FROM have) GROUP BY hash")
def _embed_pending(spark, sf_dir):
    return maintain.pending_embeddings(turns(spark, sf_dir), _vectors_of_turns(spark, sf_dir), "m1")


@_register("embed_orphans", f"WITH {_HAVE} SELECT hash, model FROM have WHERE hash NOT IN (SELECT hash FROM turns WHERE semantic)")
def _embed_orphans(spark, sf_dir):
    return maintain.orphan_embeddings(_vectors_of_turns(spark, sf_dir), turns(spark, sf_dir))


@_register("embed_coverage", f"WITH {_HAVE} SELECT count(*) AS chunks, count(*) FILTER (WHERE semantic) AS eligible, count(*) FILTER (WHERE semantic AND hash IN (SELECT hash FROM have)) AS embedded FROM turns")
def _embed_coverage(spark, sf_dir):
    return evidence.coverage(turns(spark, sf_dir), _vectors_of_turns(spark, sf_dir))


def _members(spark, sf_dir):
    t = turns(spark, sf_dir)
    gone = t.where(F.col("chunk_id") % 5 == 0).select((-F.col("chunk_id") - 1).alias("chunk_id"), "hash")
    return t.where(F.col("chunk_id") % 3 == 0).select("chunk_id", "hash").unionByName(gone).withColumn("segment", F.pmod(F.col("chunk_id"), F.lit(4)))


_MEMBERS = _HAVE + ", members AS (SELECT chunk_id, hash, ((chunk_id % 4) + 4) % 4 AS segment FROM (SELECT chunk_id, hash FROM turns WHERE chunk_id % 3 = 0 UNION ALL SELECT -chunk_id - 1, hash FROM turns WHERE chunk_id % 5 = 0))"


@_register("segment_missing", f"WITH {_MEMBERS} SELECT chunk_id, hash FROM turns t WHERE semantic AND hash IN (SELECT hash FROM have) AND NOT EXISTS (SELECT 1 FROM members m WHERE m.chunk_id = t.chunk_id AND m.hash = t.hash)")
def _segment_missing(spark, sf_dir):
    return maintain.missing_members(turns(spark, sf_dir), _vectors_of_turns(spark, sf_dir), _members(spark, sf_dir))


@_register("segment_live_ratio", f"WITH {_MEMBERS} SELECT segment, count(*) AS total, count(t.chunk_id) AS live, round(1 - CAST(count(t.chunk_id) AS DOUBLE) / count(*), 6) AS deleted_ratio FROM members m LEFT JOIN turns t ON m.chunk_id = t.chunk_id AND m.hash = t.hash AND t.semantic GROUP BY segment")
def _segment_live(spark, sf_dir):
    return maintain.live_ratio(_members(spark, sf_dir), turns(spark, sf_dir)).withColumn("deleted_ratio", F.round("deleted_ratio", 6))


@_register("segment_rebuilt", f"WITH {_HAVE} SELECT chunk_id, hash FROM turns WHERE semantic AND hash IN (SELECT hash FROM have) AND chunk_id % 4 <> 0")
def _segment_rebuilt(spark, sf_dir):
    """Segments of a third of the chunks, then of all, compacted when a quarter of the chunks is gone: what is live in them."""
    every, byte = turns(spark, sf_dir), F.crc32(F.col("hash").cast("binary"))
    have = _vectors_of_turns(spark, sf_dir).select("hash", F.array(*[(byte % n - n / 2).cast("float") for n in (97, 89, 83)]).alias("embedding"))
    s = VectorSegments(spark, f"{work_folder(spark)}/segments-{uuid.uuid4().hex}")
    s.add(every.where(F.col("chunk_id") % 3 == 0), have)
    s.add(every, have)
    left = every.where(F.col("chunk_id") % 4 != 0)
    s.compact(left)
    return s.live(left).select("chunk_id", "hash")


def _snapshots(spark, sf_dir):
    c = corpus(spark, sf_dir).select(F.col("path").alias("key"), "doc_id", "size", "mtime_ns")
    old = c.where(F.col("doc_id") % 5 != 0).withColumn("identity", F.col("doc_id").cast("string"))
    new = c.where(F.col("doc_id") % 7 != 0).withColumn("identity", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("doc_id").cast("string"))).withColumn("size", F.col("size") + (F.col("doc_id") % 3 == 0).cast("long"))
    return old, new


_SNAPSHOTS = f"""{_CORPUS}, old_files AS (SELECT path AS key, doc_id, size, mtime_ns, CAST(doc_id AS VARCHAR) AS identity FROM corpus WHERE doc_id % 5 <> 0),
new_files AS (SELECT path AS key, doc_id, size + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size, mtime_ns, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE CAST(doc_id AS VARCHAR) END AS identity FROM corpus WHERE doc_id % 7 <> 0)"""


@_register(
    "metadata_upsert",
    f"""WITH {_SNAPSHOTS} SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN 'unseen' WHEN o.key IS NULL THEN 'new' WHEN n.identity <> o.identity THEN 'replaced'
    WHEN n.size <> o.size OR n.mtime_ns <> o.mtime_ns THEN 'changed' ELSE 'same' END AS action, coalesce(n.size, o.size) AS size FROM old_files o FULL JOIN new_files n ON o.key = n.key""",
)
def _metadata_upsert(spark, sf_dir):
    return maintain.metadata_upsert(*_snapshots(spark, sf_dir))


@_register("sweep_unseen", f"WITH {_SNAPSHOTS} SELECT key, doc_id FROM old_files WHERE key NOT IN (SELECT key FROM new_files)")
def _sweep_unseen(spark, sf_dir):
    return maintain.sweep(*_snapshots(spark, sf_dir), complete=True).select("key", "doc_id")


@_register("cascade_delete", f"WITH {_TURNS} SELECT chunk_id FROM turns WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _cascade(spark, sf_dir):
    return maintain.cascade(turns(spark, sf_dir), _table(spark, sf_dir, "labels")).select("chunk_id")


def _versions(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("hash", F.substring("hash", 1, 1))  # many equal hashes
    old = t.select("doc_id", "chunk_id", "ordinal", "hash")
    new = t.where(F.col("ordinal") % 3 != 1).select("doc_id", (F.col("ordinal") + 10).alias("ordinal"), "hash")
    more = t.where(F.col("ordinal") == 0).select("doc_id", F.lit(99).cast("long").alias("ordinal"), "hash")
    return old, new.unionByName(more)


_DIFF = f"""{_TURNS}, h AS (SELECT doc_id, chunk_id, ordinal, substr(hash, 1, 1) AS hash FROM turns),
old_chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ordinal, chunk_id) AS k FROM h),
new_chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ordinal) AS k FROM (SELECT doc_id, ordinal + 10 AS ordinal, hash FROM h WHERE ordinal % 3 <> 1 UNION ALL SELECT doc_id, 99, hash FROM h WHERE ordinal = 0)),
d AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.hash, n.hash) AS hash, o.chunk_id, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal,
  CASE WHEN n.ordinal IS NULL THEN 'removed' WHEN o.ordinal IS NULL THEN 'written' ELSE 'reused' END AS action
  FROM old_chunks o FULL JOIN new_chunks n ON o.doc_id = n.doc_id AND o.hash = n.hash AND o.k = n.k)"""


@_register("chunk_diff", f"WITH {_DIFF} SELECT * FROM d")
def _chunk_diff(spark, sf_dir):
    return maintain.chunk_diff(*_versions(spark, sf_dir))


@_register("chunk_diff_counts", f"WITH {_DIFF} SELECT action, count(*) AS n FROM d GROUP BY action")
def _chunk_diff_counts(spark, sf_dir):
    return maintain.chunk_diff(*_versions(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@_register("scope_tiers", f"WITH {_CORPUS} SELECT doc_id, path <> '/data/en/src3' AND (starts_with(path, '/data/en/') OR starts_with(path, '/data/fr/')) AND NOT starts_with(path, '/data/en/src3/') AS content, extension = '.md' AND starts_with(path, '/data/fr/') AS semantic FROM corpus")
def _scope_tiers(spark, sf_dir):
    p = F.col("path")
    content = maintain.in_scope(p, ["/data/en", "/data/fr/"], ["/data/en/src3"])
    return corpus(spark, sf_dir).select("doc_id", content.alias("content"), (maintain.in_scope(p, ["/data/fr"]) & (F.col("extension") == ".md")).alias("semantic"))


@_register("scope_names", f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE (starts_with(path, '/data/en/') OR starts_with(path, '/data/fr/')) AND NOT list_has_any(string_split(lower(substr(path, 10)), '/'), ['src1', 'doc7.py']) AND doc_id % 6 <> 0")
def _scope_names(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("resolved", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("/real"), "path")).otherwise(F.col("path")))
    return rows.where(maintain.in_scope(F.col("path"), ["/data/en", "/data/fr"], names=["SRC1", "Doc7.PY"], resolved=F.col("resolved"))).select("doc_id")


# ---- synchronisation -----------------------------------------------------------------------------------


@_register("page_full", "SELECT event_id, event_type FROM events WHERE event_id > 137 AND event_id <= 900 ORDER BY event_id LIMIT 250")
def _page_full(spark, sf_dir):
    return sync.page_full(_table(spark, sf_dir, "events"), "event_id", 137, 900, 250).select("event_id", "event_type")


_TIMED = "timed AS (SELECT event_id, CAST(event_id // 40 AS BIGINT) AS updated FROM events)"


def _timed(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 40).cast("long").alias("updated"))


@_register("page_incremental", f"WITH {_TIMED} SELECT event_id, updated FROM timed WHERE (updated < 20 OR updated = 20 AND event_id <= 815) AND (updated > 9 OR updated = 9 AND event_id > 370) ORDER BY updated, event_id LIMIT 250")
def _page_incremental(spark, sf_dir):
    return sync.page_incremental(_timed(spark, sf_dir), "event_id", "updated", 5, (9, 370), (20, 815), 250)


@_register("watermark_replay", f"WITH {_TIMED} SELECT event_id, updated FROM timed WHERE updated >= 12 AND (updated < 14 OR updated = 14 AND event_id <= 599) ORDER BY updated, event_id LIMIT 250")
def _watermark_replay(spark, sf_dir):
    return sync.page_incremental(_timed(spark, sf_dir), "event_id", "updated", 12, None, (14, 599), 250)


@_register("sweep_page", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels) ORDER BY event_id LIMIT 100")
def _sweep_page(spark, sf_dir):
    seen = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"))
    return sync.sweep_page(_table(spark, sf_dir, "events"), seen, "event_id", 100).select("event_id")


@_register("snapshot_complete", "SELECT (SELECT count(*) FROM events) <= 5000 AS complete")
def _snapshot_complete(spark, sf_dir):
    return sync.bounded_snapshot(_table(spark, sf_dir, "events"), "event_id", 5000)[1]


_ROW = "concat_ws(chr(10), 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_size: ' || p_size)"


@_register("row_text", f"SELECT p_partkey, {_ROW} AS text, FALSE AS truncated FROM part")
def _row_text(spark, sf_dir):
    text, cut = row_text(["p_name", "p_brand", "p_size"])
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), cut.alias("truncated"))


@_register("row_version", f"""SELECT sha256('["src", "part", "p_partkey", ' || p_partkey || ']') AS key, sha256({_ROW}) AS version FROM part""")
def _row_version(spark, sf_dir):
    return sync.as_documents(_table(spark, sf_dir, "part"), "src", "part", "p_partkey", ["p_name", "p_brand", "p_size"]).select("key", "version")


@_register("unique_keys", "SELECT 'event_id' AS \"column\", count(*) AS rows, count(DISTINCT event_id) AS \"distinct\", count(*) FILTER (WHERE event_id IS NULL) AS nulls, TRUE AS is_key FROM events UNION ALL SELECT 'user_id', count(*), count(DISTINCT user_id), count(*) FILTER (WHERE user_id IS NULL), count(*) = count(DISTINCT user_id) FROM events")
def _unique_keys(spark, sf_dir):
    return sync.unique_keys(_table(spark, sf_dir, "events"), ["event_id", "user_id"])


_KINDS = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END"
_FIELDS = f"fields AS (SELECT table_name AS t, column_name AS c, ordinal_position AS p, {_KINDS} AS k FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _TABLES)}))"


@_register("inspect_source", f'WITH {_FIELDS} SELECT t AS "table", CAST(p - 1 AS INT) AS position, c AS "column", k AS type, TRUE AS nullable FROM fields')
def _inspect(spark, sf_dir):
    return Source({t: _table(spark, sf_dir, t) for t in _TABLES}).inspect(spark)


@_register(
    "recommend_source",
    f"""WITH {_FIELDS}, m AS (SELECT *, k IN ('bigint', 'int', 'string') AND (lower(c) = 'id' OR ends_with(lower(c), '_id') OR ends_with(lower(c), 'key')) AS is_key,
      k = 'timestamp_ntz' OR lower(c) IN ({", ".join(repr(n) for n in sync.TIME_NAMES)}) AS is_time FROM fields)
    SELECT t AS "table", coalesce(string_agg(c, ',' ORDER BY p) FILTER (WHERE is_key), '') AS keys, coalesce(string_agg(c, ',' ORDER BY p) FILTER (WHERE is_time), '') AS watermarks,
      coalesce(string_agg(c, ',' ORDER BY p) FILTER (WHERE k = 'string' AND NOT is_key), '') AS texts FROM m GROUP BY t""",
)
def _recommend(spark, sf_dir):
    out = sync.recommend({t: _table(spark, sf_dir, t) for t in _TABLES}, spark)
    return out.select("table", *[F.array_join(c, ",").alias(c) for c in ("keys", "watermarks", "texts")])


# ---- events ----------------------------------------------------------------------------------------------


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "purchase").alias("is_directory"))


@_register("event_coalesce", "SELECT CAST(user_id AS VARCHAR) AS path, bool_or(event_type = 'purchase') AS is_directory, count(*) AS version, max(epoch_us(ts)) AS last_at FROM events GROUP BY user_id")
def _event_coalesce(spark, sf_dir):
    return streams.coalesce_events(changes(spark, sf_dir))


@_register(
    "throughput_60s",
    "WITH s AS (SELECT epoch_us(ts) // 1000000 AS second, count(*) AS n FROM events GROUP BY 1) SELECT CAST(second AS BIGINT) AS second, n, CAST(sum(n) OVER (ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM s",
)
def _throughput(spark, sf_dir):
    return streams.throughput(changes(spark, sf_dir), F.floor(F.col("at") / 1_000_000).cast("long"))


_QUIET, _CAP = 3_600_000_000, 6 * 3_600_000_000


@_register(
    "event_debounce",
    f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
    walk AS (SELECT path, k, moment AS first_us, moment AS last, 1 AS n, 1 AS burst FROM e WHERE k = 1 UNION ALL
      SELECT e.path, e.k, CASE WHEN fresh THEN e.moment ELSE first_us END, e.moment, CASE WHEN fresh THEN 1 ELSE n + 1 END, burst + CASE WHEN fresh THEN 1 ELSE 0 END
      FROM (SELECT w.*, e.moment >= least(w.last + {_QUIET}, w.first_us + {_CAP}) AS fresh FROM walk w JOIN e ON e.path = w.path AND e.k = w.k + 1) x JOIN e ON e.path = x.path AND e.k = x.k + 1)
    SELECT path, first_us, least(max(last) + {_QUIET}, first_us + {_CAP}) AS emitted_us, CAST(max(n) AS BIGINT) AS events FROM walk GROUP BY path, burst, first_us""",
)
def _event_debounce(spark, sf_dir):
    return streams.debounce(changes(spark, sf_dir), at="at", quiet=_QUIET, cap=_CAP)


@_register("event_classes", "SELECT event_id, CASE WHEN event_id * 37 & 4608 <> 0 THEN 'delete' WHEN event_id * 37 & 1114112 <> 0 THEN 'reconcile' WHEN event_id * 37 & 8567 <> 0 THEN 'upsert' END AS action FROM events")
def _event_classes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", streams.classify(F.col("event_id") * 37).alias("action"))


# ---- vectors kept and made, hits checked again -------------------------------------------------------


_HALF = "pow(2::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10)"


@_register(
    "vec_half_precision",
    f"SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x = 0 THEN 0::BIGINT ELSE CAST(round_even(x / {_HALF}, 0) * {_HALF} * 16777216 AS BIGINT) END), ',') AS units FROM embeddings",
)
def _vec_half(spark, sf_dir):
    """The half-precision form as multiples of its smallest unit, 2 ** -24."""
    rows = vectors.unpacked(vectors.packed(_table(spark, sf_dir, "embeddings"), "vec_id", dim=64), "vec_id", 64)
    return rows.select("vec_id", F.array_join(F.transform("embedding", lambda x: (x.cast("double") * (1 << 24)).cast("long").cast("string")), ",").alias("units"))


@_register("embed_encode")
def _embed_encode(spark, sf_dir):
    return vectors.encoded(turns(spark, sf_dir).where("semantic"), "chunk_id", "text", vectors.hashing_provider, "hashing-64")


@_register("hits_revalidated", f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def _hits_revalidated(spark, sf_dir):
    n, own = F.col("doc_id"), F.col("doc_id").cast("string")
    c = corpus(spark, sf_dir)
    hits = c.select("doc_id", "path", own.alias("identity"))
    there = c.select("path", F.when(n % 3 == 0, "other").otherwise(own).alias("identity"), (n % 5 == 0).alias("is_link"), (n % 7 != 0).alias("in_scope"))
    return vectors.still_valid(hits, there).select("doc_id")


@_register(
    "kw_cited",
    _bm25_sql(_WORDS) + """, page AS (SELECT *, doc_id % 4 = 0 AS moved FROM hits ORDER BY round(hits.score, 9), doc_id LIMIT 20)
    SELECT doc_id, doc_id % 3 = 0 OR moved AS stale, CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id ELSE (CASE WHEN moved THEN mtime_ns + 1 ELSE mtime_ns END) || ':' || size END AS revision FROM page""",
)
def _kw_cited(spark, sf_dir):
    n = F.col("doc_id")
    c = corpus(spark, sf_dir)
    page = _documents_index(spark, sf_dir).search(_QUERY).select("doc_id", "score")
    now = c.select("doc_id", "source_id", "path", "size", F.col("mtime_ns").alias("indexed_mtime_ns"), F.col("size").alias("indexed_size"), (F.col("mtime_ns") + (n % 4 == 0).cast("long")).alias("mtime_ns"), F.when(n % 3 == 0, "row").otherwise("file").alias("kind"), F.when(n % 2 == 0, F.concat(F.lit("v"), n.cast("string"))).alias("version"), F.lit(None).cast("string").alias("locator"), F.lit(0).alias("indexed_at"))
    return search.shown(page, now).select("doc_id", "citation.stale", "citation.revision")


# ---- extraction and chunking -----------------------------------------------------------------------------


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(_table(spark, sf_dir, "pages"))
    return p.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))


@_register("page_text")
def _page_text(spark, sf_dir):
    out = files.extract(page_files(spark, sf_dir), files.WHOLE, files.WHOLE)
    return out.select("path", "status", "truncated", F.size("chunks").alias("pieces"), F.array_join(F.transform("chunks", lambda c: c["text"]), "\n").alias("text"))


@_register("chunk_documents")
def _chunk_documents(spark, sf_dir):
    d = corpus(spark, sf_dir).select(F.concat("path", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_documents(files.extract(d, files.WHOLE, files.WHOLE), most_chars=files.WHOLE)


@_register("kw_bm25_chunk")
def _kw_bm25_chunk(spark, sf_dir):
    chunks = _chunk_documents(spark, sf_dir).select(F.concat_ws("#", "path", "ordinal").alias("chunk"), "path", "text")
    hits = search.keyword_scores(chunks, _QUERY, shown=["chunk", "path"])  # texts are read, cut and counted once
    best = search.best_chunk(hits, "path", [F.round("score", 9), F.col("chunk")])
    return best.orderBy(F.round("score", 9), "chunk").limit(20).select("chunk", _rounded())


# ---- diagnosis and quality ----------------------------------------------------------------------------------

_ASKED = f"""{_STATES}, asked AS (SELECT path, doc_id % 13 <> 0 AS in_scope, doc_id % 17 <> 0 AS on_disk, doc_id % 19 <> 0 AS readable, FALSE AS is_directory, size + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS size, mtime_ns, CASE WHEN doc_id % 29 = 0 THEN 'x' ELSE 'i' || doc_id END AS identity, doc_id % 31 <> 0 AS content_allowed, doc_id FROM states),
known AS (SELECT path, status, size, mtime_ns, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE 'i' || doc_id END AS identity FROM states WHERE doc_id % 41 <> 0)"""


@_register(
    "diagnose_codes",
    f"""WITH {_ASKED} SELECT a.path, CASE WHEN NOT in_scope THEN 'excluded_or_outside_scope' WHEN NOT on_disk THEN 'missing_or_moved' WHEN NOT readable THEN 'permission_denied_or_unavailable'
    WHEN is_directory THEN 'directory_coverage' WHEN k.path IS NULL THEN 'not_discovered' WHEN k.identity IS NULL THEN 'legacy_identity_unverified' WHEN k.identity <> a.identity THEN 'replaced_file'
    WHEN k.size <> a.size OR k.mtime_ns <> a.mtime_ns THEN 'stale' WHEN NOT content_allowed THEN 'content_excluded' WHEN status = 'pending' THEN 'content_pending' WHEN status = 'error' THEN 'extraction_failed'
    WHEN status = 'partial' THEN 'partial_content' ELSE 'ready' END AS code FROM asked a LEFT JOIN known k ON a.path = k.path""",
)
def _diagnose(spark, sf_dir):
    return _diagnosed(spark, sf_dir)


def _diagnosed(spark, sf_dir):
    s = states(spark, sf_dir)
    n = F.col("doc_id")
    own = F.concat(F.lit("i"), n.cast("string"))
    asked = s.select("path", (n % 13 != 0).alias("in_scope"), (n % 17 != 0).alias("exists"), (n % 19 != 0).alias("readable"), F.lit(False).alias("is_directory"), (F.col("size") + (n % 23 == 0).cast("long")).alias("size"), "mtime_ns", F.when(n % 29 == 0, "x").otherwise(own).alias("identity"), (n % 31 != 0).alias("content_allowed"))
    known = s.where(n % 41 != 0).select("path", "status", "size", "mtime_ns", F.when(n % 37 != 0, own).alias("identity"))
    return evidence.diagnose(asked, known)


@_register(
    "diagnose_evidence",
    f"""WITH {_ASKED}, ready AS (SELECT a.path, a.doc_id FROM asked a JOIN known k ON a.path = k.path WHERE in_scope AND on_disk AND readable AND k.identity = a.identity AND k.size = a.size AND k.mtime_ns = a.mtime_ns AND content_allowed AND status = 'ready'),
    m AS (SELECT path, list_has_any(t, {_WORDS}) AS keyword_match, contains(lower(path), '{_QUERY}') AS filename_match FROM ready JOIN tokens USING (doc_id))
    SELECT path, keyword_match, filename_match, CASE WHEN keyword_match OR filename_match THEN 'match' ELSE 'no_keyword_match_in_indexed_content' END AS query_assessment, 'fetch' AS actions FROM m""",
)
def _diagnose_evidence(spark, sf_dir):
    rows, found = corpus(spark, sf_dir), evidence.with_actions(_diagnosed(spark, sf_dir))
    out = evidence.query_evidence(found, rows, rows, _QUERY).where("code = 'ready'")
    return out.select("path", "keyword_match", "filename_match", "query_assessment", F.array_join("actions", ",").alias("actions"))


@_register(
    "progress_state",
    """WITH f AS (SELECT doc_id AS id, doc_id % 11 = 0 AS paused, doc_id % 7 = 0 AS held, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS due, doc_id % 13 = 0 AS active_root, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS queued_directories,
      CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS discovery_errors, doc_id % 23 = 0 AS unavailable_root, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS retrying, TRUE AS semantic, doc_id % 29 <> 0 AS model_ready FROM documents),
    g AS (SELECT *, NOT active_root AND queued_directories = 0 AND discovery_errors = 0 AND NOT unavailable_root AS discovery_complete FROM f)
    SELECT id, discovery_complete, CASE WHEN paused THEN 'paused' WHEN held THEN 'waiting' WHEN due > 0 OR (NOT discovery_complete AND discovery_errors = 0 AND NOT unavailable_root) THEN 'indexing'
      WHEN errors > 0 OR discovery_errors > 0 OR unavailable_root THEN 'needs_attention' WHEN retrying > 0 THEN 'waiting' WHEN NOT model_ready THEN 'model_not_ready' ELSE 'up_to_date' END AS state FROM g""",
)
def _progress(spark, sf_dir):
    n = F.col("doc_id")

    def when(k, v=1):
        return F.when(n % k == 0, v).otherwise(0)

    facts = _table(spark, sf_dir, "documents").select(
        n.alias("id"), (n % 11 == 0).alias("paused"), (n % 7 == 0).alias("held"), when(5, 3).alias("due"), (n % 13 == 0).alias("active_root"), when(17).alias("queued_directories"), when(19).alias("discovery_errors"),
        (n % 23 == 0).alias("unavailable_root"), when(3).alias("errors"), when(2).alias("retrying"), F.lit(True).alias("semantic"), (n % 29 != 0).alias("model_ready"),
    )
    return evidence.progress_state(facts).select("id", "discovery_complete", "state")


@_register(
    "recall_at_k",
    f"""WITH {_CORPUS}, tok AS (SELECT doc_id, unnest(t) AS term FROM tokens), lens AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS length FROM tokens),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean FROM lens),
    wanted AS (SELECT DISTINCT item_id AS case_id, unnest(regexp_extract_all(lower({_FOLD}), '[a-z0-9]+')) AS term FROM benchmark),
    post AS (SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM tok WHERE term IN (SELECT term FROM wanted) GROUP BY term, doc_id),
    with_term AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term),
    odds AS (SELECT term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS o FROM with_term, stats),
    scored AS (SELECT case_id, doc_id, sum(-(CASE WHEN o > 0 THEN o ELSE 0.000001::DOUBLE END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
      FROM post JOIN odds USING (term) JOIN wanted USING (term) JOIN lens USING (doc_id), stats GROUP BY case_id, doc_id),
    placed AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9), doc_id) - 1 AS rank FROM scored),
    firsts AS (SELECT p.case_id, min(rank) AS first FROM placed p JOIN benchmark b ON b.item_id = p.case_id JOIN documents d ON d.doc_id = p.doc_id WHERE rank < 10 AND contains(d.text, b.text) GROUP BY p.case_id)
    SELECT CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS "group", count(*) AS cases, round(avg(CASE WHEN first < 5 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS recall_5,
      round(avg(CASE WHEN first < 10 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS recall_10, round(avg(first), 6) AS mean_first_rank FROM benchmark b LEFT JOIN firsts f ON f.case_id = b.item_id GROUP BY 1""",
)
def _recall(spark, sf_dir):
    """Each benchmark passage searched as a query over all documents; relevant: documents that hold it."""
    from tarnfold.functions.text import index_tokens

    d, b = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    wanted = b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("term"))
    # written, so that its size is known: where a few rows a passage are small, they go to the texts, and texts are not shuffled
    at = f"{work_folder(spark)}/hits-{uuid.uuid4().hex}"
    _documents_index(spark, sf_dir).batch(wanted, 10).select(F.col("query_id").alias("case_id"), "doc_id", "rank").write.parquet(at)
    hits = spark.read.parquet(at)
    held = hits.join(d.select("doc_id", "text"), "doc_id").join(b.select(F.col("item_id").alias("case_id"), F.col("text").alias("passage")), "case_id").where(F.col("text").contains(F.col("passage"))).select("case_id", "doc_id")
    cases = b.select(F.col("item_id").alias("case_id"), F.when(F.length("text") < 200, "short").otherwise("long").alias("group"))
    out = evidence.recall(hits, held, cases)
    return out.select("group", "cases", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mean_first_rank")])


@_register("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def _latency(spark, sf_dir):
    out = evidence.latency(_table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "most")


@_register("json_rows", """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || ',"o_orderdate":"' || o_orderdate || '","o_orderpriority":"' || o_orderpriority || '"}' AS json FROM orders""")
def _json_rows(spark, sf_dir):
    from tarnfold.plans.structured import json_rows

    return json_rows(_table(spark, sf_dir, "orders"))


# ---- scheduling, scope, fixed values -----------------------------------------------------------------------------


_QUEUE = _WORK + ", docs AS (SELECT doc_id, text, source FROM documents WHERE doc_id % 9 <> 0)"


@_register(
    "due_files",
    f"""WITH {_QUEUE}, due AS (SELECT w.* FROM work w JOIN docs d ON d.doc_id = w.doc_id WHERE available_at <= 30), old AS (SELECT doc_id FROM due WHERE priority <= 0 ORDER BY available_at, doc_id LIMIT 10)
    SELECT doc_id, attempts, priority, source FROM (SELECT due.*, CASE WHEN doc_id IN (SELECT doc_id FROM old) THEN 0 WHEN priority > 0 THEN 1 ELSE 2 END AS turn FROM due ORDER BY turn, priority DESC, available_at, doc_id LIMIT 40) JOIN docs USING (doc_id)""",
)
def _due_files(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where("doc_id % 9 != 0").select("doc_id", "source")
    return schedule.due_files(_work(spark, sf_dir), documents, 30, 40).select("doc_id", "attempts", "priority", "source")


@_register(
    "due_directories",
    """SELECT url AS path, page_id % 7 AS root, page_id % 3 = 0 AS urgent FROM pages WHERE page_id % 7 IN (1, 2, 5) ORDER BY page_id % 3 = 0 DESC, page_id % 11, url LIMIT 25""",
)
def _due_directories(spark, sf_dir):
    n = F.col("page_id")
    directories = _table(spark, sf_dir, "pages").select(F.col("url").alias("path"), (n % 7).alias("root"), (n % 3 == 0).alias("priority"), (n % 11).alias("arrived"))
    roots = spark.createDataFrame([(i, "discover" if i in (1, 2, 5) else "done", f"g{i}") for i in range(7)], "root long, phase string, generation string")
    return schedule.due_directories(directories, roots, 25).select("path", "root", F.col("priority").alias("urgent"))


_LOADS = """loads AS (SELECT n_regionkey AS source, CAST(n_regionkey AS INT) AS position, n_nationkey AS "table", CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS "index",
  2 AS next_table, 40 AS page_size, n_nationkey % 6 <> 5 AS due, CAST(n_nationkey * 17 % 130 AS BIGINT) AS remaining FROM nation)"""


@_register(
    "round_robin",
    f"""WITH {_LOADS}, live AS (SELECT *, max(position + 1) OVER () AS sources, max("index" + 1) OVER (PARTITION BY source) AS tables FROM loads WHERE due AND remaining > 0),
    paged AS (SELECT *, unnest(range(least(CAST(ceil(remaining / 40) AS BIGINT), 5))) AS page FROM live),
    sized AS (SELECT *, least(40, remaining - page * 40) AS size, row_number() OVER w AS nth, coalesce(sum(least(40, remaining - page * 40)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM paged WINDOW w AS (PARTITION BY source ORDER BY page, ("index" - next_table + tables * 5) % tables))
    SELECT CAST((position - 3 + sources * 5) % sources AS INT) AS turn, source, "table", CAST(page AS INT) AS page, CAST(least(size, 150 - before) AS BIGINT) AS rows, CAST(nth AS INT) AS nth FROM sized WHERE nth <= 5 AND before < 150""",
)
def _round_robin(spark, sf_dir):
    from pyspark.sql import Window

    n = F.col("n_nationkey")
    index = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    loads = _table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("source"), F.col("n_regionkey").alias("position"), n.alias("table"), index.alias("index"), F.lit(2).alias("next_table"), F.lit(40).alias("page_size"), (n % 6 != 5).alias("due"), (n * 17 % 130).cast("long").alias("remaining")
    )
    return schedule.round_robin(loads, 3, 5, 150)


_JOBS = """jobs AS (SELECT c_custkey AS job, 'running' AS status, CAST(c_custkey % 4 AS INT) AS attempts, CAST(c_custkey AS VARCHAR) AS cursor FROM customer),
commands AS (SELECT o_custkey AS job, o_orderkey AS moment, CASE o_orderkey % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' ELSE 'cancel' END AS command FROM orders WHERE o_orderkey % 5 = 0)"""


@_register(
    "job_control",
    f"""WITH {_JOBS}, last AS (SELECT job, arg_max(command, moment) AS command, bool_or(command = 'cancel') AS cancelled FROM commands GROUP BY job)
    SELECT j.job, CASE command WHEN 'pause' THEN 'paused' WHEN 'cancel' THEN 'cancelled' ELSE 'running' END AS status, CASE WHEN cancelled THEN 0 ELSE attempts END AS attempts, CASE WHEN cancelled THEN NULL ELSE cursor END AS cursor FROM jobs j LEFT JOIN last l ON l.job = j.job""",
)
def _job_control(spark, sf_dir):
    n = F.col("c_custkey")
    jobs = _table(spark, sf_dir, "customer").select(n.alias("job"), F.lit("running").alias("status"), (n % 4).cast("int").alias("attempts"), n.cast("string").alias("cursor"))
    k = F.col("o_orderkey")
    commands = _table(spark, sf_dir, "orders").where(k % 5 == 0).select(F.col("o_custkey").alias("job"), k.alias("at"), F.when(k % 3 == 0, "pause").when(k % 3 == 1, "resume").otherwise("cancel").alias("command"))
    return schedule.control(jobs, commands)


@_register(
    "publish_results",
    f"""WITH {_STATES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'changed_during_read' END AS reason,
      doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND status NOT IN ('pending', 'error') AS publish FROM states WHERE doc_id % 11 <> 0""",
)
def _publish_results(spark, sf_dir):
    n, own = F.col("doc_id"), F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    s = states(spark, sf_dir)
    read = s.select("doc_id", "path", "size", "mtime_ns", own.alias("identity"), "status", F.lit(None).cast("string").alias("reason"))
    present = s.where(n % 7 != 0).select("path", (F.col("size") + (n % 5 == 0).cast("long")).alias("size"), "mtime_ns", own.alias("identity"))
    documents = s.select("doc_id", F.when(n % 11 == 0, "other").otherwise(own).alias("identity"))
    return schedule.publish_results(read, present, documents)


_AFTER = "CASE WHEN failed THEN 100 + least(3600::DOUBLE, 60 * pow(2::DOUBLE, least(attempts, 6))) ELSE CAST(available_at AS DOUBLE) END"


@_register(
    "commit_batch",
    f"WITH {_WORK} SELECT doc_id, {_AFTER} AS available_at, attempts + CASE WHEN failed THEN 1 ELSE 0 END AS attempts, priority FROM (SELECT *, doc_id % 20 = 3 AND doc_id % 2 = 1 AS failed FROM work)",
)
def _commit_batch(spark, sf_dir):
    """A batch of the odd documents of which some fail: it is rolled back as a whole."""
    work = _work(spark, sf_dir)
    outcome = work.where("doc_id % 2 = 1").select("doc_id", (F.col("doc_id") % 20 == 3).alias("failed"))
    return schedule.commit_batch(work, outcome, 100)


@_register("commit_batch_whole", f"WITH {_WORK} SELECT doc_id, CAST(available_at AS DOUBLE) AS available_at, attempts, priority FROM work WHERE doc_id % 2 = 0")
def _commit_batch_whole(spark, sf_dir):
    work = _work(spark, sf_dir)
    return schedule.commit_batch(work, work.where("doc_id % 2 = 1").select("doc_id", F.lit(False).alias("failed")), 100)


def _narrower():
    p = F.col("path")
    return maintain.in_scope(p, ["/data/en", "/data/fr"], ["/data/en/src2"]), maintain.in_scope(p, [], ["/data/fr/src1"], "all")


_NARROWER = "(starts_with(path, '/data/en/') OR starts_with(path, '/data/fr/')) AND NOT starts_with(path, '/data/en/src2/')"
_REVOKED = f"gone AS (SELECT doc_id, CASE WHEN NOT ({_NARROWER}) THEN 'remove' WHEN starts_with(path, '/data/fr/src1/') AND status IN ('ready', 'partial', 'pending') THEN 'clear' END AS action FROM states)"


@_register("scope_revoked", f"WITH {_STATES}, {_REVOKED} SELECT * FROM gone WHERE action IS NOT NULL")
def _scope_revoked(spark, sf_dir):
    return schedule.revoked(states(spark, sf_dir), *_narrower())


@_register("scope_preview", f"WITH {_STATES}, {_REVOKED} SELECT count(*) AS checked, count(*) FILTER (WHERE action = 'remove') AS removed, count(*) FILTER (WHERE action = 'clear') AS content_removed FROM gone")
def _scope_preview(spark, sf_dir):
    return schedule.scope_preview(states(spark, sf_dir), *_narrower())


_FOLDERS = "folders AS (SELECT DISTINCT '/data/' || lang || '/' || source AS path FROM documents)"


@_register(
    "reconcile_targets",
    f"""WITH {_FOLDERS}, asked AS (SELECT DISTINCT '/data/' || lang || '/' || source || CASE WHEN doc_id % 3 = 0 THEN '/gone' || doc_id % 4 ELSE '' END AS path FROM documents WHERE doc_id % 2 = 0),
    aim AS (SELECT CASE WHEN path IN (SELECT path FROM folders) THEN path ELSE regexp_replace(path, '/[^/]*$', '') END AS path FROM asked)
    SELECT DISTINCT CASE WHEN starts_with(path, '/data/en/') THEN path END AS target, NOT starts_with(path, '/data/en/') AS "full" FROM aim""",
)
def _reconcile_targets(spark, sf_dir):
    n = F.col("doc_id")
    folder = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source")
    d = _table(spark, sf_dir, "documents")
    gone = F.when(n % 3 == 0, F.concat(F.lit("/gone"), (n % 4).cast("string"))).otherwise("")
    asked = d.select(F.concat(folder, gone).alias("path"), (n % 2 == 0).alias("is_directory"))
    return schedule.reconcile_targets(asked, d.select(folder.alias("path")), maintain.in_scope(F.col("path"), ["/data/en"]))


@_register("watched_events", "SELECT '/u/' || user_id % 10 || '/' || user_id AS path, bool_or(event_type = 'purchase') AS is_directory, count(*) AS version, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at FROM events WHERE user_id % 10 IN (3, 7) GROUP BY user_id")
def _watched_events(spark, sf_dir):
    n = F.col("path").cast("long")
    moved = changes(spark, sf_dir).withColumn("path", F.concat(F.lit("/u/"), (n % 10).cast("string"), F.lit("/"), F.col("path")))
    return schedule.watched_events(moved, ["/u/3/", "/u/7"])


@_register(
    "prioritized",
    f"""WITH {_WORK}, {_CORPUS}, asked AS (SELECT doc_id FROM corpus WHERE doc_id % 6 = 0 AND starts_with(path, '/data/en/')), queue AS (SELECT * FROM work WHERE doc_id % 4 <> 0)
    SELECT doc_id, CAST(available_at AS DOUBLE) AS available_at, attempts, priority FROM queue WHERE doc_id NOT IN (SELECT doc_id FROM asked)
    UNION ALL SELECT a.doc_id, 0, coalesce(attempts, 0), 1 FROM asked a LEFT JOIN queue q ON q.doc_id = a.doc_id""",
)
def _prioritized(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "path")
    return schedule.prioritized(_work(spark, sf_dir).where("doc_id % 4 != 0"), c.where("doc_id % 6 = 0").select("path"), c, maintain.in_scope(F.col("path"), ["/data/en"]))


@_register("file_identities", "SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'unavailable' ELSE o_custkey % 3 || ':' || o_custkey % 9 END AS identity FROM orders")
def _file_identities(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", schedule.file_identity(F.col("o_custkey") % 3, F.col("o_custkey") % 9).alias("identity"))


@_register(
    "snapshot_tables",
    """WITH n AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 20), r AS (SELECT * FROM region ORDER BY r_regionkey LIMIT 20)
    SELECT 'nation' AS "table", CAST(n_nationkey AS VARCHAR) AS row_id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS row, NULL::BOOLEAN AS complete, NULL AS reason FROM n
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', NULL, NULL FROM r
    UNION ALL SELECT 'nation', NULL, NULL, count(*) <= 20, CASE WHEN count(*) > 20 THEN 'row_limit' END FROM nation UNION ALL SELECT 'region', NULL, NULL, count(*) <= 20, CASE WHEN count(*) > 20 THEN 'row_limit' END FROM region""",
)
def _snapshot_tables(spark, sf_dir):
    return sync.snapshot_rows({"nation": (_table(spark, sf_dir, "nation"), "n_nationkey"), "region": (_table(spark, sf_dir, "region"), "r_regionkey")}, 20)


@_register("cycle_full", "SELECT event_id, user_id FROM events")
def _cycle_full(spark, sf_dir):
    return sync.TableSync(_table(spark, sf_dir, "events"), "event_id").cycle(0.0)[0].select("event_id", "user_id")


_NAMES = "'/home/a/' || list_extract(['.env', 'Credentials', 'credentials.JSON', '.ENV.local', '.ssh/known', 'notes.psm1', 'rakefile', 'x/.AWS/y', 'id_ed25519', 'env', '.netrc', 'a.hrl'], CAST(doc_id % 12 + 1 AS INT))"


@_register(
    "sensitive_paths",
    f"""SELECT doc_id, path, list_extract(string_split(lower(path), '/'), -1) IN ('.env', '.npmrc', '.pypirc', 'credentials', 'credentials.json', 'id_rsa', 'id_ed25519') OR starts_with(list_extract(string_split(lower(path), '/'), -1), '.env.')
      OR len(list_intersect(string_split(lower(path), '/'), ['.ssh', '.aws', '.azure', '.gnupg', '.kube'])) > 0 AS sensitive FROM (SELECT doc_id, {_NAMES} AS path FROM documents)""",
)
def _sensitive_paths(spark, sf_dir):
    names = [".env", "Credentials", "credentials.JSON", ".ENV.local", ".ssh/known", "notes.psm1", "rakefile", "x/.AWS/y", "id_ed25519", "env", ".netrc", "a.hrl"]
    path = F.concat(F.lit("/home/a/"), F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % 12 + 1).cast("int")))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("sensitive", maintain.is_sensitive(F.col("path")))


_CODE = ".py .pyi .js .mjs .cjs .ts .jsx .tsx .java .go .rs .c .cpp .cc .cxx .h .hpp .cs .sh .bash .zsh .ps1 .psm1 .sql .css .scss .sass .less .r .rb .php .swift .kt .kts .scala .vue .svelte .lua .pl .dart .ex .exs .erl .hrl .clj .cljs .fs .fsx .vb .bat .cmd .properties .gitignore .dockerignore .editorconfig"


@_register("category_code", f"SELECT doc_id, e AS extension FROM (SELECT doc_id, list_extract(['.py', '.psm1', '.hrl', '.sass', '.log', '.md', '.editorconfig', '.gradle', '.json'], CAST(doc_id % 9 + 1 AS INT)) AS e FROM documents) WHERE e IN ({', '.join(repr(x) for x in _CODE.split())})")
def _category_code(spark, sf_dir):
    names = [".py", ".psm1", ".hrl", ".sass", ".log", ".md", ".editorconfig", ".gradle", ".json"]
    extension = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % 9 + 1).cast("int")).alias("extension")
    return search.Filters(category="code", file_source=None).apply(_table(spark, sf_dir, "documents").select("doc_id", extension))
