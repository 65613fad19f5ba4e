"""Synchronising relational sources: keyset pages, watermarks, completeness, source onboarding."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.text import row_text

TIME_NAMES = ("updated_at", "updated", "modified_at", "modified", "last_modified", "mtime", "ts", "changed_at")


def sync_scalar(value):
    """A value that a checkpoint may hold, or an error."""
    if value is None or isinstance(value, (bool, bytes)):
        raise ValueError("keys and watermarks are ordered scalars, not null")
    if isinstance(value, (float, Decimal)) and not math.isfinite(value):
        raise ValueError("keys and watermarks are finite")
    if isinstance(value, (datetime, date, Decimal, UUID)):
        value = str(value)
    if not isinstance(value, (str, int, float)) or isinstance(value, str) and len(value) > 2048:
        raise ValueError("keys and watermarks are short scalars")
    return value


def page_full(rows: DataFrame, key: str, after, boundary, size: int) -> DataFrame:
    """The next ``size`` rows by key, up to the boundary that was fixed when the cycle began."""
    scope = rows.where(F.col(key) <= F.lit(boundary))
    if after is not None:
        scope = scope.where(F.col(key) > F.lit(after))
    return scope.orderBy(key).limit(size)


def page_incremental(rows: DataFrame, key: str, updated: str, watermark, after, boundary, size: int) -> DataFrame:
    """The next rows by (updated, key): at or after the watermark (its ties are read again), up to the boundary."""
    at = F.struct(F.col(updated), F.col(key))

    def pair(x):
        return F.struct(F.lit(x[0]).cast(rows.schema[updated].dataType), F.lit(x[1]).cast(rows.schema[key].dataType))

    scope = rows.where(F.col(updated) >= F.lit(watermark).cast(rows.schema[updated].dataType)) if watermark is not None else rows
    scope = scope.where(at <= pair(boundary))
    if after is not None:
        scope = scope.where(at > pair(after))
    return scope.orderBy(updated, key).limit(size)


def boundary_of(rows: DataFrame, key: str, updated: str | None = None):
    """The largest key, or (updated, key), at this moment."""
    at = F.col(key) if updated is None else F.struct(F.col(updated), F.col(key))
    found = rows.agg(F.max(at).alias("m")).first()["m"]
    return None if found is None else found if updated is None else tuple(found)


@dataclass
class Checkpoint:
    """State of a source table's sync: where the page is, where the cycle ends, what is behind it."""

    cursor: object = None
    boundary: object = None
    watermark: object = None
    mode: str = "full"
    last_full: float = 0.0

    def to_json(self) -> str:
        def plain(v):
            return [sync_scalar(x) for x in v] if isinstance(v, (list, tuple)) else None if v is None else sync_scalar(v)

        return json.dumps({k: plain(v) if k in ("cursor", "boundary", "watermark") else v for k, v in self.__dict__.items()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Checkpoint:
        return cls(**json.loads(text))


def choose_mode(updated: str | None, state: Checkpoint, now: float, reconcile: float) -> str:
    return "full" if updated is None or state.watermark is None or now - state.last_full >= reconcile else "incremental"


class TableSync:
    """Reads a table in pages: the cycle's end is fixed at its start, so it ends while the table grows."""

    def __init__(self, rows: DataFrame, key: str, updated: str | None = None, size: int = 250, reconcile: float = 3600.0):
        if not 1 <= size <= 1000:
            raise ValueError("a page has 1 to 1000 rows")
        self.rows, self.key, self.updated, self.size, self.reconcile = rows, key, updated, size, reconcile

    def page(self, state: Checkpoint, now: float) -> tuple[DataFrame, Checkpoint, bool]:
        """A page, the checkpoint behind it, and whether the cycle is over."""
        if state.boundary is None:
            mode = choose_mode(self.updated, state, now, self.reconcile)
            by_pair = self.updated is not None
            state = Checkpoint(None, boundary_of(self.rows, self.key, self.updated if mode == "incremental" else None), state.watermark, mode, state.last_full)
            if by_pair and mode == "full":
                state.watermark = boundary_of(self.rows, self.key, self.updated)
            if state.boundary is None:
                return self.rows.limit(0), Checkpoint(watermark=state.watermark, last_full=now if mode == "full" else state.last_full), True
        if state.mode == "full":
            page = self._read(page_full(self.rows, self.key, state.cursor, state.boundary, self.size))
            cursor = max((r[self.key] for r in page), default=None)
        else:
            low = state.watermark[0] if state.watermark else None
            page = self._read(page_incremental(self.rows, self.key, self.updated, low, state.cursor, state.boundary, self.size))
            cursor = max(((r[self.updated], r[self.key]) for r in page), default=state.cursor)
        over = len(page) < self.size
        page = self.rows.sparkSession.createDataFrame(page, self.rows.schema)
        if over:
            mark = state.watermark if state.mode == "full" else state.boundary
            return page, Checkpoint(None, None, mark, state.mode, now if state.mode == "full" else state.last_full), True
        return page, Checkpoint(cursor, state.boundary, state.watermark, state.mode, state.last_full), False

    def _read(self, page: DataFrame) -> list:
        """The page's rows (at most ``size``), read once: what the caller gets is what the cursor has passed."""
        return page.select(*self.rows.columns).collect()

    def cycle(self, now: float) -> tuple[DataFrame, Checkpoint]:
        """A full cycle in one parallel read, for the first load of a large table: rows up to the boundary, and the checkpoint behind them.

        The rows are a plan over the source, not pages; write them before the checkpoint. Read a database by ``by_key_ranges``.
        """
        whole = self.rows.agg(F.max(self.key).alias("k"), *([F.max(F.struct(self.updated, self.key)).alias("m")] if self.updated else [])).first()
        mark = tuple(whole["m"]) if self.updated and whole["m"] is not None else None
        rows = self.rows.limit(0) if whole["k"] is None else self.rows.where(F.col(self.key) <= F.lit(whole["k"]))
        return rows, Checkpoint(watermark=mark, last_full=now)


def bounded_snapshot(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows by key, and one row that says whether they are all (never guessed)."""
    probe = rows.orderBy(key).limit(most + 1)
    return rows.orderBy(key).limit(most), probe.agg((F.count("*") <= most).alias("complete"))


def snapshot_rows(tables: dict[str, tuple[DataFrame, str]], most: int) -> DataFrame:
    """Bounded snapshots of several tables in one: ``table, row_id, row`` (JSON), and behind each table's rows a marker.

    A marker has a null ``row_id`` and says ``complete`` and why not (``reason``: row_limit, null_key). A table without a marker was not
    read to its end; its completeness is never concluded from the rows. ``tables``: name to (rows, key).
    """
    out = None
    for name, (rows, key) in sorted(tables.items()):
        held = rows.where(F.col(key).isNotNull()).orderBy(key).limit(most)
        body = held.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("row_id"), F.to_json(F.struct(*rows.columns)).alias("row"), F.lit(None).cast("boolean").alias("complete"), F.lit(None).cast("string").alias("reason"))
        facts = rows.agg(F.count(key).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
        reason = F.when(F.col("n") > most, "row_limit").when(F.col("nulls") > 0, "null_key")
        marker = facts.select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("row_id"), F.lit(None).cast("string").alias("row"), reason.isNull().alias("complete"), reason.alias("reason"))
        both = body.unionByName(marker)
        out = both if out is None else out.unionByName(both)
    return out


def sweep_page(known: DataFrame, seen: DataFrame, key: str, size: int) -> DataFrame:
    """The next unseen keys to delete, in key order."""
    return known.join(seen.select(key).distinct(), key, "left_anti").orderBy(key).limit(size)


def document_key(source: str, table: str, id_column: str, value: Column) -> Column:
    """SHA-256 of the JSON list of source, table, id column and id."""
    head = json.dumps([source, table, id_column], ensure_ascii=False)[:-1]
    return F.sha2(F.concat(F.lit(head + ", "), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("]")).cast("binary"), 256)


def as_documents(rows: DataFrame, source: str, table: str, key: str, columns: list[str]) -> DataFrame:
    """Rows as documents: key, text, truncated, version (SHA-256 of the text kept)."""
    text, cut = row_text(columns)
    return rows.select(document_key(source, table, key, F.col(key)).alias("key"), F.col(key).alias("row_id"), text.alias("text"), cut.alias("truncated")).withColumn("version", F.sha2(F.col("text").cast("binary"), 256))


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def unique_keys(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """``column, rows, distinct, nulls, is_key`` of each candidate in one pass."""
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(candidates):
        aggregates += [F.count_distinct(c).alias(f"d{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}")]
    one = rows.agg(*aggregates)
    items = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"d{i}").alias("distinct"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(candidates)]
    return one.select(F.inline(F.array(*items))).withColumn("is_key", (F.col("nulls") == 0) & (F.col("distinct") == F.col("rows")))


def recommend(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Candidate key, watermark and text columns of each table, from schemas alone, of all tables and columns."""
    out = []
    for name in sorted(tables):
        fields = tables[name].schema.fields
        keys = [f.name for f in fields if isinstance(f.dataType, (T.IntegralType, T.StringType)) and (f.name.lower() == "id" or f.name.lower().endswith(("_id", "key")))]
        times = [f.name for f in fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or f.name.lower() in TIME_NAMES]
        texts = [f.name for f in fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
        out.append((name, keys, times, texts))
    return spark.createDataFrame(out, "table string, keys array<string>, watermarks array<string>, texts array<string>")


def proposal(selections: list[dict], tables: dict[str, DataFrame]) -> dict:
    """An allowlist configuration from explicit selections (table, key, texts, updated)."""
    index, columns = [], {}
    for s in selections:
        schema = tables[s["table"]].columns
        wanted = [s["key"], *s["texts"], *([s["updated"]] if s.get("updated") else [])]
        unknown = [c for c in wanted if c not in schema]
        if unknown or not 1 <= len(s["texts"]) <= 50:
            raise ValueError(f"unknown or missing columns: {unknown}")
        columns[s["table"]] = list(dict.fromkeys(wanted))
        index.append({"table": s["table"], "id_column": s["key"], "text_columns": s["texts"], "updated_column": s.get("updated")})
    notes = [f"{i['table']}: no watermark, read in full each time" for i in index if not i["updated_column"]]
    return {"allowed_tables": list(columns), "allowed_columns": columns, "index": index, "notes": notes}


def preflight(rows: DataFrame, key: str, columns: list[str], updated: str | None = None) -> dict:
    """Whether a table can be synchronised: columns, stable key, ordered types, no nulls."""
    missing = [c for c in [key, *columns, *([updated] if updated else [])] if c not in rows.columns]
    if missing:
        return {"ok": False, "code": "column_unavailable", "columns": missing}
    rows.select(key, *columns).limit(0).collect()
    ordered = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FractionalType)
    for c in [key, *([updated] if updated else [])]:
        if not isinstance(rows.schema[c].dataType, ordered):
            return {"ok": False, "code": "unordered_type", "columns": [c]}
    found = unique_keys(rows, [key]).first()
    if found["nulls"]:
        return {"ok": False, "code": "null_key", "columns": [key]}
    if not found["is_key"]:
        return {"ok": False, "code": "duplicate_key", "columns": [key]}
    if updated and rows.where(F.col(updated).isNull()).limit(1).count():
        return {"ok": False, "code": "null_watermark", "columns": [updated]}
    return {"ok": True, "code": "ready", "columns": []}
