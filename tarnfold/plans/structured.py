"""Structured queries: a validated JSON request becomes a DataFrame plan, never SQL text.

The language has projection, conjunctive filters, up to four inner or left equi-joins, five aggregates,
grouping, ordering and paging, over an allowlist of tables and columns. Catalyst plans the rest: only the
columns that a request names reach the scan, filters are pushed to it, ordered pages become a top-k.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions.text import fold_ascii

MOST = {"joins": 4, "columns": 100, "aggregates": 20, "filters": 50, "group_by": 20, "order_by": 20}
MOST_TEXT, MOST_VALUES, MOST_OFFSET = 10_000, 500, 1_000_000
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


class RequestError(ValueError):
    """A request that the language or the allowlist does not permit."""


def _need(holds: bool, reason: str) -> None:
    if not holds:
        raise RequestError(reason)


def _listed(request: Mapping, name: str) -> list:
    items = request.get(name, [])
    _need(isinstance(items, list) and len(items) <= MOST[name], f"{name} must be a list of at most {MOST[name]}")
    return items


def _shape(item, allowed: str, required: str) -> None:
    _need(isinstance(item, Mapping), "an object is expected")
    names = set(item)
    _need(names <= set(allowed.split()), f"unknown fields: {sorted(names - set(allowed.split()))}")
    _need(set(required.split()) <= names, f"missing fields: {sorted(set(required.split()) - names)}")


def _name(value) -> str:
    _need(isinstance(value, str) and 0 < len(value) <= 256 and "\0" not in value, "invalid identifier")
    return value


def _number(value, what: str, low: int, high: int) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and low <= value <= high, f"{what} must be an integer from {low} to {high}")
    return value


def _scalar(value) -> Column:
    _need(value is None or isinstance(value, (str, int, float, bool)), "filter values must be scalars")
    _need(not isinstance(value, str) or len(value) <= MOST_TEXT, "filter text is too long")
    _need(not isinstance(value, float) or math.isfinite(value), "filter numbers must be finite")
    return F.lit(value)


@dataclass
class Source:
    """Tables that may be queried. ``columns`` narrows a table to the listed ones; unlisted tables show all.

    ``text_case``: ``exact`` compares text filters byte by byte, ``ascii`` folds A-Z.
    """

    tables: Mapping[str, DataFrame]
    columns: Mapping[str, list[str]] = field(default_factory=dict)
    max_rows: int = 200
    max_result_chars: int = 200_000
    text_case: str = "exact"
    source_id: str = "source"

    def __post_init__(self):
        _need(set(self.columns) <= set(self.tables), "columns are listed for an unknown table")
        _number(self.max_rows, "max_rows", 1, 10_000)
        _number(self.max_result_chars, "max_result_chars", 100, 2_000_000)
        _need(self.text_case in ("exact", "ascii"), "text_case is exact or ascii")

    def visible(self, table: str) -> list[str]:
        _need(_name(table) in self.tables, "table is unavailable or not allowed")
        there = self.tables[table].columns
        return [c for c in there if c in set(self.columns.get(table, there))]

    def inspect(self, spark) -> DataFrame:
        """One row per visible column: table, position, column, type, nullable."""
        rows = []
        for t in sorted(self.tables):
            shown = self.visible(t)
            rows += [(t, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(f for f in self.tables[t].schema if f.name in shown)]
        return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")

    def plan(self, request: Mapping, probe: bool = False) -> DataFrame:
        """The page as a DataFrame; with ``probe`` one row more, which tells whether there is a next page."""
        return _Compiler(self, request).page(probe)

    def query(self, request: Mapping) -> dict:
        """The page's rows on the driver (at most ``max_rows``), cut at the character budget."""
        began = time.monotonic()
        compiled = _Compiler(self, request)
        rows = within_budget(compiled.page(True), compiled.limit, self.max_result_chars, compiled.orders).collect()
        labels = compiled.labels
        return {
            "source_id": self.source_id,
            "columns": labels,
            "rows": [{c: json_value(r[c]) for c in labels} for r in rows if r["__kept"]],
            "row_count": sum(r["__kept"] for r in rows),
            "truncated": any(not r["__kept"] for r in rows),
            "elapsed_ms": round(1000 * (time.monotonic() - began), 2),
            "queried_at": datetime.now(UTC).isoformat(),
        }


class _Compiler:
    def __init__(self, source: Source, request: Mapping):
        _shape(request, "table columns filters order_by limit offset joins aggregates group_by", "table")
        self.source, self.request = source, request
        self.base = request["table"]
        joins = _listed(request, "joins")
        self.order = [self.base]
        for j in joins:
            _shape(j, "table left right type", "table left right")
            _need(j["table"] not in self.order, "a table can be joined once")
            self.order.append(j["table"])
        self.shown = {t: source.visible(t) for t in self.order}
        self.handle = {t: f"t{i}" for i, t in enumerate(self.order)}
        self.limit = _number(request.get("limit", min(20, source.max_rows)), "limit", 1, source.max_rows)
        self.offset = _number(request.get("offset", 0), "offset", 0, MOST_OFFSET)
        self.frame = self._joined(joins)
        self.frame = reduce(DataFrame.where, [self._predicate(p) for p in _listed(request, "filters")], self.frame)
        self._project()

    def _find(self, reference) -> tuple[str, str]:
        _name(reference)
        if reference in self.shown[self.base]:
            return self.base, reference
        found = [(t, reference[len(t) + 1 :]) for t in self.order if reference.startswith(f"{t}.") and reference[len(t) + 1 :] in self.shown[t]]
        _need(len(found) == 1, "column is unavailable or not allowed")
        return found[0]

    def _column(self, reference) -> Column:
        table, column = self._find(reference)
        return F.col(f"{self.handle[table]}.`{column.replace('`', '``')}`")

    def _joined(self, joins: list) -> DataFrame:
        def scan(table):
            return self.source.tables[table].select(*[F.col(f"`{c.replace('`', '``')}`") for c in self.shown[table]]).alias(self.handle[table])

        frame = scan(self.base)
        for k, j in enumerate(joins, 1):
            kind = j.get("type", "inner")
            _need(kind in ("inner", "left"), "a join is inner or left")
            sides = {self._find(j["left"])[0], self._find(j["right"])[0]}
            _need(j["table"] in sides and len(sides) == 2 and (sides - {j["table"]}) <= set(self.order[:k]), "a join must connect the new table to an earlier one")
            frame = frame.join(scan(j["table"]), self._column(j["left"]) == self._column(j["right"]), kind)
        return frame

    def _predicate(self, p) -> Column:
        _shape(p, "column op value", "column op")
        c, op, value = self._column(p["column"]), p["op"], p.get("value")
        if op in ("eq", "ne") and value is None:
            return c.isNull() if op == "eq" else c.isNotNull()
        if op in COMPARISONS:
            _need(value is not None, "only eq and ne take null")
            return COMPARISONS[op](c, _scalar(value))
        if op in ("is_null", "not_null"):
            return c.isNull() if op == "is_null" else c.isNotNull()
        if op in ("in", "not_in"):
            _need(isinstance(value, list) and 1 <= len(value) <= MOST_VALUES, f"{op} takes 1 to {MOST_VALUES} values")
            found = c.isin([_scalar(v) for v in value])
            return found if op == "in" else ~found
        if op in ("contains", "starts_with"):
            _need(isinstance(value, str), f"{op} takes text")
            text, wanted = c.cast("string"), _scalar(value)
            if self.source.text_case == "ascii":
                text, wanted = fold_ascii(text), fold_ascii(wanted)
            return text.contains(wanted) if op == "contains" else text.startswith(wanted)
        if op == "between":
            _need(isinstance(value, list) and len(value) == 2, "between takes two values")
            return c.between(_scalar(value[0]), _scalar(value[1]))
        raise RequestError("unsupported filter operator")

    def _project(self) -> None:
        request = self.request
        aggregates, groups = _listed(request, "aggregates"), _listed(request, "group_by")
        selected = _listed(request, "columns") if "columns" in request else [] if aggregates else sorted(self.shown[self.base])
        places, grouped = [self._find(c) for c in selected], [self._find(g) for g in groups]
        self.labels, made = list(selected), []
        for a in aggregates:
            _shape(a, "function column alias", "function column alias")
            _need(a["function"] in AGGREGATES, "unsupported aggregate")
            if a["column"] == "*":
                _need(a["function"] == "count", "only count takes *")
                over = F.lit(1)
            else:
                over = self._column(a["column"])
            made.append(AGGREGATES[a["function"]](over).alias(_name(a["alias"])))
            self.labels.append(a["alias"])
        _need(bool(self.labels) and len(set(self.labels)) == len(self.labels), "select something, under unique names")
        frame = self.frame
        aliases = {a["alias"] for a in aggregates}
        if aggregates or groups:
            _need(all(p in grouped for p in places), "every selected column must be grouped")
            keys = {p: f"__g{i}" for i, p in enumerate(dict.fromkeys(grouped))}
            by = [self._column(g).alias(keys[p]) for g, p in zip(groups, grouped, strict=True)]
            by = list({keys[p]: b for b, p in zip(by, grouped, strict=True)}.values())
            frame = frame.groupBy(*by).agg(*made) if made else frame.select(*by).distinct()

            def at(reference):
                place = self._find(reference)
                _need(place in keys, "an ordering column must be grouped")
                return F.col(keys[place])
        else:
            at = self._column
        self.orders, order_columns = [], []
        for i, o in enumerate(_listed(request, "order_by")):
            _shape(o, "column direction", "column")
            direction = o.get("direction", "asc")
            _need(direction in ("asc", "desc"), "a direction is asc or desc")
            c = F.col(f"`{o['column']}`") if o["column"] in aliases else at(o["column"])
            order_columns.append(c.alias(f"__o{i}"))
            self.orders.append(F.col(f"__o{i}").asc_nulls_first() if direction == "asc" else F.col(f"__o{i}").desc_nulls_last())
        shown = [at(c).alias(c) for c in selected] + [F.col(f"`{a['alias']}`") for a in aggregates]
        self.frame = frame.select(*shown, *order_columns)

    def page(self, probe: bool) -> DataFrame:
        frame = self.frame.orderBy(*self.orders) if self.orders else self.frame
        frame = (frame.offset(self.offset) if self.offset else frame).limit(self.limit + probe)
        return frame if probe else frame.select(*[F.col(f"`{c}`") for c in self.labels])


def within_budget(page: DataFrame, limit: int, chars: int, orders: list[Column]) -> DataFrame:
    """``page`` with ``__kept``: the row is in the first ``limit`` and the JSON so far is in the budget.

    The page is bounded by a limit, so that a window over all of it stays small.
    """
    shown = [c for c in page.columns if not c.startswith("__")]
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown]), {"ignoreNullFields": "false"}))
    order = orders or [F.monotonically_increasing_id()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return page.withColumn("__kept", (F.sum(size).over(upto) <= chars) & (F.row_number().over(Window.orderBy(*order)) <= limit))


def json_value(value):
    """Lossless JSON forms: decimals and dates as text, bytes as base64, non-finite numbers as text."""
    import base64
    from datetime import date, timedelta
    from decimal import Decimal

    if isinstance(value, (bytes, bytearray)):
        return {"base64": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, float) and not math.isfinite(value) or isinstance(value, (Decimal, date, datetime, timedelta)):
        return str(value)
    if isinstance(value, Mapping):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_value(v) for v in value]
    return value


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text with the same conversions, as one column expression."""

    def ready(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.BinaryType):
            return F.when(c.isNotNull(), F.struct(F.base64(c).alias("base64")))
        if isinstance(t, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string")
        return c  # non-finite numbers are written as text already

    row = F.struct(*[ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))
