"""SQLite files as tables: read by row ranges in tasks, read-only, without a driver of Spark's.

``spark.read.format("sqlite").option("path", file).option("table", name)`` needs the file at the same path in the driver and in all tasks. A
table is read in ranges of row numbers, a task each; ``columns`` names those that are read, and with ``pushFilters`` (which needs
``spark.sql.python.filterPushdown.enabled``) simple filters are put into the statement. All tasks read one state of the file: each checks
that no writer has changed it since the plan was made, and fails if one has (``changed while it was read``).
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterable
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

# The format's rules for a column's kind, by what its declared type contains, in this order.
KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(path: str, timeout: float = 5.0) -> sqlite3.Connection:
    """A read-only connection that waits at most ``timeout`` seconds for a lock."""
    connection = sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True, timeout=timeout)
    connection.execute("PRAGMA query_only = ON")
    return connection


def state_of(path: str) -> tuple:
    """The file's change counter, and its write-ahead log's size and time."""
    with open(path, "rb") as f:
        head = f.read(100)
    if not head.startswith(b"SQLite format 3\0"):
        raise ValueError("not a SQLite file")
    log = f"{path}-wal"
    s = os.stat(log) if os.path.exists(log) else None
    return struct.unpack(">I", head[24:28])[0], os.stat(path).st_size, s and s.st_size, s and s.st_size and s.st_mtime_ns


def kind_of(declared: str) -> T.DataType:
    upper = declared.upper()
    return next((k for part, k in KINDS if part in upper), T.StringType() if declared else T.BinaryType())


def quoted(name: str) -> str:
    if not name or "\0" in name:
        raise ValueError("invalid identifier")
    return '"' + name.replace('"', '""') + '"'


def columns_of(connection: sqlite3.Connection, table: str) -> list[tuple[str, str, bool, int]]:
    """(name, declared type, nullable, place in the primary key or 0) of a table or view."""
    rows = connection.execute(f"PRAGMA table_xinfo({quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table}")
    return [(r[1], r[2], not r[3] and not r[5], r[5]) for r in rows if r[6] != 1]


def described(spark: SparkSession, path: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """``table, kind, position, column, declared, type, nullable, key_position`` of a file's tables and views, of those allowed only."""
    out = []
    with closing(opened(path)) as c:
        for table, kind in c.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name").fetchall():
            if allowed is None or table in allowed:
                shown = [x for x in columns_of(c, table) if allowed is None or x[0] in allowed[table]]
                out += [(table, kind, i, name, declared, kind_of(declared).simpleString(), null, key or None) for i, (name, declared, null, key) in enumerate(shown)]
    return spark.createDataFrame(out, "table string, kind string, position int, column string, declared string, type string, nullable boolean, key_position int")


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None, state: tuple):
        self.low, self.high, self.state = low, high, state


class _Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.size, self.timeout = int(options.get("size", 100_000)), float(options.get("timeout", 5))
        if self.size < 1 or not 0 < self.timeout <= 60:
            raise ValueError("size from 1, timeout up to 60 seconds")
        self.tests: list[tuple[str, list]] = []

    def partitions(self) -> list[_Rows]:
        state = state_of(self.path)
        with closing(opened(self.path, self.timeout)) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row numbers
                return [_Rows(None, None, state)]
        if not isinstance(low, int):  # no rows, or none with a number
            return [_Rows(None, None, state)]
        step = max(self.size, (high - low) // 100_000 + 1)  # however far apart the numbers are
        return [_Rows(a, min(a + step - 1, high), state) for a in range(low, high + 1, step)]

    def read(self, part: _Rows):
        tests, values = [t for t, _ in self.tests], [v for _, own in self.tests for v in own]
        if part.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [part.low, part.high]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        takes = [(f.name, _TAKES[type(f.dataType)]) for f in self.schema.fields]
        with closing(opened(self.path, self.timeout)) as c:
            c.execute("BEGIN")
            cursor = c.execute(f"SELECT {', '.join(quoted(f) for f in self.schema.names)} FROM {quoted(self.table)}{where}", values)
            if state_of(self.path) != part.state:
                raise RuntimeError(f"{self.path} changed while it was read")
            while rows := cursor.fetchmany(1000):
                for row in rows:
                    yield tuple(None if v is None else take(name, v) for (name, take), v in zip(takes, row, strict=True))


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what means the same in SQLite: comparisons of numbers, equality of texts, null tests."""
        for f in filters:
            test = self._test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _test(self, f: Filter) -> tuple[str, list] | None:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.schema.names:
            return None
        name, kind = quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType
        number = isinstance(kind, (T.LongType, T.DoubleType))
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
        if isinstance(f, In) and (number or isinstance(kind, T.StringType)) and len(f.value) <= 500 and None not in f.value:
            return f"{name} COLLATE BINARY IN ({', '.join('?' * len(f.value))})", list(f.value)
        if type(f) in COMPARED and f.value is not None and (number or isinstance(f, EqualTo) and isinstance(kind, T.StringType)):
            return f"{name} {COMPARED[type(f)]} ? COLLATE BINARY", [f.value]
        if isinstance(f, StringStartsWith) and isinstance(kind, T.StringType):
            return f"substr({name}, 1, ?) = ? COLLATE BINARY", [len(f.value), f.value]
        return None


def _whole(name, v):
    if not isinstance(v, int):
        raise ValueError(f"{name} holds {type(v).__name__} in a column of whole numbers")
    return v


def _number(name, v):
    if not isinstance(v, (int, float)):
        raise ValueError(f"{name} holds {type(v).__name__} in a column of numbers")
    return float(v)


#: Values of another kind than their column's, which SQLite allows: their text where the column is text, else an error, never a null.
_TAKES = {
    T.LongType: _whole,
    T.DoubleType: _number,
    T.StringType: lambda _, v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v),
    T.BinaryType: lambda _, v: v if isinstance(v, bytes) else str(v).encode(),
}


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        with closing(opened(self.options["path"])) as c:
            held = {name: T.StructField(name, kind_of(declared)) for name, declared, _, _ in columns_of(c, self.options["table"])}
        if unknown := [c for c in wanted if c not in held]:
            raise ValueError(f"unknown columns: {unknown}")
        return T.StructType([held[c] for c in wanted or held])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (_Pushing if self.options.get("pushFilters", "false").lower() == "true" else _Reader)(self.options, schema)
