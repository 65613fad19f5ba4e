"""A relational table as a stream: cycles of key ranges whose offset holds the boundary and the watermark.

``table_source(name, connect)`` makes a data source of any DB-API connection:

    spark.dataSource.register(table_source("orders_db", lambda: sqlite3.connect("/shared/orders.db")))
    spark.readStream.format("orders_db").option("table", "orders").option("key", "id").option("updated", "changed").load()

A batch is a cycle. Its end (the largest key, and the largest (updated, key)) is fixed before it is read, so it ends while the table grows. Its
start is the offset before it, which is in the query's checkpoint: rows from that watermark on are read, its ties again. At first, and when
the time of ``reconcile`` seconds passes into a new stretch, the cycle is full: all rows up to the largest key, and behind them one row
``complete``, by which keys that were not seen can be swept. A table without ``updated`` has full cycles only.

Tasks read ranges of about ``size`` keys each; the driver sees range ends. Rows come as JSON (``row``) with their key as text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tarnfold.operators.sync import sync_scalar

SCHEMA = "kind string, cycle long, row_id string, row string"
#: One stretch of time for ever: only the first cycle is full.
NEVER = 0


@dataclass
class _Range(InputPartition):
    """Rows with ``low`` < key <= ``high`` (a side that is None is open), of a full cycle or from a watermark on."""

    low: object
    high: object
    watermark: object
    boundary: object
    cycle: int
    full: bool
    last: bool


class _Reader(DataSourceStreamReader):
    def __init__(self, options, connect, mark, clock):
        self.connect, self.mark, self.clock = connect, mark, clock
        self.table, self.key, self.updated = options["table"], options["key"], options.get("updated")
        self.columns = [c for c in options.get("columns", "").split(",") if c] or ["*"]
        self.size, self.reconcile = int(options.get("size", 50_000)), float(options.get("reconcile", 3600))
        if self.size < 1 or self.reconcile < 0:
            raise ValueError("size from 1, reconcile from 0 seconds")
        for name in (self.table, self.key, self.updated, *self.columns):
            if name is not None and name != "*" and not all(p.isidentifier() for p in name.split(".")):
                raise ValueError(f"not a plain name: {name}")

    def _rows(self, sql: str, *values) -> list:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            return cursor.fetchall()
        finally:
            connection.close()

    def initialOffset(self) -> dict:
        return {"cycle": -1, "key": None, "updated": None}

    def latestOffset(self) -> dict:
        """The table's end now. It depends on nothing before it, so it is the same for a query that was started again."""
        cycle = int(self.clock() // self.reconcile) if self.reconcile else NEVER
        ((key,),) = self._rows(f"SELECT max({self.key}) FROM {self.table}")
        if key is None:
            return {"cycle": cycle, "key": None, "updated": None}
        if self.updated is None:
            return {"cycle": cycle, "key": sync_scalar(key), "updated": None}
        ((updated,),) = self._rows(f"SELECT max({self.updated}) FROM {self.table}")
        last = None
        if updated is not None:  # rows of equal time and a later key are of a later batch
            ((last,),) = self._rows(f"SELECT max({self.key}) FROM {self.table} WHERE {self.updated} = {self.mark}", updated)
        return {"cycle": cycle, "key": sync_scalar(key), "updated": None if updated is None else json.dumps([sync_scalar(updated), sync_scalar(last)])}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        cycle, full = end["cycle"], start["cycle"] != end["cycle"] or self.updated is None or start["updated"] is None
        if end["key"] is None:
            return [_Range(None, None, None, None, cycle, full, True)] if full else []
        boundary = json.loads(end["updated"]) if end["updated"] else None
        if full:
            where, values = f"{self.key} <= {self.mark}", [end["key"]]
        else:
            low, boundary = json.loads(start["updated"])[0], boundary or [None, None]
            where, values = f"{self.updated} >= {self.mark} AND {self.updated} <= {self.mark}", [low, boundary[0]]
        ranked = f"SELECT {self.key} AS k, row_number() OVER (ORDER BY {self.key}) AS r FROM {self.table} WHERE {where}"
        cuts = [k for (k,) in self._rows(f"SELECT k FROM ({ranked}) q WHERE r % {self.size} = 0 ORDER BY k", *values)]
        edges = [None, *cuts, None]
        low = None if full else json.loads(start["updated"])[0]
        return [_Range(a, b if b is not None else end["key"] if full else None, low, boundary, cycle, full, b is None) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, part: _Range):
        tests, values = [], []
        if part.boundary is None and not part.full:
            return
        for test, value in ((f"{self.key} > {self.mark}", part.low), (f"{self.key} <= {self.mark}", part.high)):
            if value is not None:
                tests.append(test)
                values.append(value)
        if not part.full:
            last = f"({self.updated} < {self.mark} OR {self.updated} = {self.mark} AND {self.key} <= {self.mark})"
            tests += [f"{self.updated} >= {self.mark}", last]
            values += [part.watermark, part.boundary[0], *part.boundary]
        if tests:
            connection = self.connect()
            try:
                cursor = connection.cursor()
                shown = ", ".join(self.columns)
                cursor.execute(f"SELECT {self.key}, {shown} FROM {self.table} WHERE {' AND '.join(tests)} ORDER BY {self.key}", values)
                names = [d[0] for d in cursor.description][1:]
                while rows := cursor.fetchmany(1000):
                    for row in rows:
                        yield "row", part.cycle, str(row[0]), json.dumps(dict(zip(names, row[1:], strict=True)), default=_text, ensure_ascii=False)
            finally:
                connection.close()
        if part.full and part.last:
            yield "complete", part.cycle, None, None

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset."""

    def stop(self) -> None:
        """Connections are closed as they are read."""


def _text(value) -> str:
    return value.hex() if isinstance(value, (bytes, bytearray, memoryview)) else str(value)


def table_source(name: str, connect: Callable[[], object], mark: str = "?", clock: Callable[[], float] = time.time) -> type[DataSource]:
    """A data source of tables behind ``connect`` (called in the driver and in tasks); ``mark``: the driver's parameter mark."""

    class TableSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema):
            return _Reader(self.options, connect, mark, clock)

    return TableSource
