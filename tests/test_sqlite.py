"""SQLite files against the standard module, in ranges, with filters, one state for all tasks."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnfold.plans.structured import Source
from tarnfold.sources import sqlite


@pytest.fixture
def file(spark, tmp_path):
    spark.dataSource.register(sqlite.SqliteFile)
    path = str(tmp_path / "a?#b.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE orders (id INTEGER PRIMARY KEY, customer VARCHAR(20) NOT NULL, amount REAL, note TEXT, "odd ""name" BLOB, day DATE)')
        c.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?, ?)", [(i * 3, f"c{i % 7}", None if i % 9 == 0 else i / 4, None if i % 5 == 0 else f"n{i}é", bytes([i % 256]), f"2024-01-{i % 28 + 1:02}") for i in range(1000)])
        c.execute("CREATE TABLE plain (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
        c.execute("INSERT INTO plain VALUES ('x', 1), ('y', NULL)")
        c.execute("CREATE VIEW large AS SELECT id, amount FROM orders WHERE amount > 200")
        c.execute("CREATE TABLE empty (a INT)")
    return path


def load(spark, path, table, **options):
    r = spark.read.format("sqlite").option("path", path).option("table", table)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def truth(path, sql):
    with sqlite3.connect(path) as c:
        return sorted(map(repr, c.execute(sql).fetchall()))


def rows(df):
    return sorted(repr(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in df.collect())


def test_tables_are_read_in_ranges(spark, file):
    df = load(spark, file, "orders", size=500)
    assert df.dtypes == [("id", "bigint"), ("customer", "string"), ("amount", "double"), ("note", "string"), ('odd "name', "binary"), ("day", "string")]
    assert df.rdd.getNumPartitions() == 6 and rows(df) == truth(file, "SELECT * FROM orders")
    assert rows(load(spark, file, "orders", columns="note,id")) == truth(file, "SELECT note, id FROM orders")
    assert rows(load(spark, file, "plain")) == truth(file, "SELECT * FROM plain") and rows(load(spark, file, "large")) == truth(file, "SELECT * FROM large")
    assert load(spark, file, "empty").count() == 0


def test_filters_reach_the_file(spark, file):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, file, "orders", size=700, pushFilters="true")
        for test, sql in (
            ((F.col("id") > 600) & (F.col("id") <= 900), "id > 600 AND id <= 900"),
            (F.col("customer") == "c3", "customer = 'c3'"),
            (F.col("customer").isin("c1", "C2"), "customer IN ('c1', 'C2')"),
            (F.col("note").isNull() & (F.col("amount") >= 10), "note IS NULL AND amount >= 10"),
            (F.col("note").startswith("n1"), "substr(note, 1, 2) = 'n1'"),
            (F.col("note") > "n5", "note > 'n5'"),
        ):
            assert rows(df.where(test)) == truth(file, f"SELECT * FROM orders WHERE {sql}"), sql
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_one_state_for_all_tasks(spark, file):
    df = load(spark, file, "orders", size=500)
    reader = sqlite._Reader({"path": file, "table": "orders", "size": "500"}, df.schema)
    parts = reader.partitions()
    first = list(reader.read(parts[0]))
    assert len(first) == 167
    with sqlite3.connect(file) as c:
        c.execute("UPDATE orders SET note = 'changed' WHERE id = 2997")
    with pytest.raises(RuntimeError, match="changed while it was read"):
        list(reader.read(parts[-1]))
    assert df.where("note = 'changed'").count() == 1  # a new plan reads the new state


def test_what_is_not_allowed(spark, file, tmp_path):
    with sqlite3.connect(file) as c:
        c.execute("INSERT INTO empty VALUES ('text')")
    with pytest.raises(Exception, match="column of whole numbers"):
        load(spark, file, "empty").collect()
    with sqlite3.connect(str(tmp_path / "n.db")) as c:
        c.execute("CREATE TABLE t (v NUMERIC, s TEXT)")
        c.execute("INSERT INTO t VALUES (1.5, 7), ('x', x'c3a9')")
    assert rows(load(spark, str(tmp_path / "n.db"), "t")) == ["('1.5', '7')", "('x', 'é')"]
    (tmp_path / "not.db").write_bytes(b"no database at all" * 20)
    for bad in ({"path": str(tmp_path / "not.db"), "table": "t"}, {"path": file, "table": "none"}, {"path": file, "table": "orders", "columns": "id,secret"}):
        with pytest.raises(Exception):  # noqa: B017
            load(spark, bad.pop("path"), bad.pop("table"), **bad).collect()
    with pytest.raises(sqlite3.OperationalError):
        sqlite.opened(file).execute("DELETE FROM orders")


def test_described_and_queried(spark, file):
    got = [tuple(r) for r in sqlite.described(spark, file, {"orders": ["id", "customer"], "large": ["id"]}).collect()]
    assert got == [("large", "view", 0, "id", "INTEGER", "bigint", True, None), ("orders", "table", 0, "id", "INTEGER", "bigint", False, 1), ("orders", "table", 1, "customer", "VARCHAR(20)", "string", False, None)]
    page = Source({"orders": load(spark, file, "orders", columns="id,customer,amount")}).query({"table": "orders", "columns": ["id"], "filters": [{"column": "customer", "op": "eq", "value": "c3"}], "order_by": [{"column": "id", "direction": "asc"}], "limit": 2})
    assert [r["id"] for r in page["rows"]] == [9, 30]
