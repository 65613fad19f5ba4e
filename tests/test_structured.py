"""The request language on a small harbour: answers against DuckDB, and values that each field must refuse."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from tarnfold.plans import structured
from tarnfold.plans.structured import RequestError, Source, json_rows, json_value

SHIPS = "ship long, name string, flag string, tons double, cabin string"
CALLS = "visit long, vessel long, port string, fee long, moment timestamp, remark string"


def harbour():
    dice = random.Random(11)
    names = ["Möwe", "100%_sure", "ICE", "ice maid", "", None, "O'Hara", "seven!"]
    ships = [(i, names[i % 8], dice.choice(["PA", "LR", None]), dice.choice([0.5, 120.0, 7_000.25, None]), f"c{i}") for i in range(24)]
    start = datetime(2023, 5, 1)
    calls = [(1000 + i, dice.choice([None, *range(27)]), dice.choice(["Bergen", "bergen", "Porto_1"]), dice.choice([None, 0, 15, 15, 900]), start + timedelta(hours=7 * i), dice.choice([None, "late", "50% off"])) for i in range(90)]
    return ships, calls


@pytest.fixture(scope="module")
def source(spark):
    ships, calls = harbour()
    return Source({"ships": spark.createDataFrame(ships, SHIPS), "calls": spark.createDataFrame(calls, CALLS)}, {"ships": ["ship", "name", "flag", "tons"]}, max_rows=500)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table, schema, rows in zip(("ships", "calls"), (SHIPS, CALLS), harbour(), strict=True):
        kinds = [c.strip().split() for c in schema.split(",")]
        made = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "timestamp": "TIMESTAMP"}
        con.execute(f"CREATE TABLE {table} ({', '.join(f'{n} {made[k]}' for n, k in kinds)})")
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(kinds))})", rows)
    return con


def literal(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def said_in_sql(column, op, value):
    if op in ("eq", "ne") and value is None or op in ("is_null", "not_null"):
        return f"{column} IS {'NOT ' * (op in ('ne', 'not_null'))}NULL"
    sign = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.get(op)
    if sign:
        return f"{column} {sign} {literal(value)}"
    if op in ("in", "not_in"):
        return f"{column} {'NOT ' * (op == 'not_in')}IN ({', '.join(map(literal, value))})"
    if op == "between":
        return f"{column} BETWEEN {literal(value[0])} AND {literal(value[1])}"
    return f"{op.replace('starts_with', 'prefix')}({column}, {literal(value)})"


def every_filter():
    """Each operator on a text, a whole and a fractional column, with values of the table and others."""
    values = {"name": ["ICE", "", "100%_sure", "O'Hara", "nobody"], "ship": [0, 11, 23, 99], "tons": [0.5, 120.0, -1.5]}
    for column, found in values.items():
        for op in structured.COMPARISONS:
            yield from ((column, op, v) for v in found)
        for op in ("eq", "ne", "is_null", "not_null"):
            yield column, op, None
        for op in ("in", "not_in"):
            yield from ((column, op, v) for v in (found[:1], found, [*found[:2], None]))
        yield column, "between", sorted(found)[:2]
        yield column, "between", sorted(found)[::-1][:2]  # nothing lies between these
    for op in ("contains", "starts_with"):
        yield from (("name", op, v) for v in ("ice", "I", "%", "_", "!", "", "Mö"))


@pytest.mark.parametrize("column", ["name", "ship", "tons"])
def test_every_operator(source, duck, column):
    for column_, op, value in every_filter():
        if column_ == column:
            request = {"table": "ships", "columns": ["ship"], "filters": [{"column": column, "op": op, "value": value}], "order_by": [{"column": "ship"}], "limit": 500}
            want = [r[0] for r in duck.execute(f"SELECT ship FROM ships WHERE {said_in_sql(column, op, value)} ORDER BY ship").fetchall()]
            assert [r["ship"] for r in source.query(request)["rows"]] == want, (op, value)


def test_operators_are_all_tried():
    assert {op for _, op, _ in every_filter()} == {*structured.COMPARISONS, "is_null", "not_null", "in", "not_in", "between", "contains", "starts_with"}


def test_filters_all_hold_and_text_is_no_code(source, duck):
    def found(*filters):
        request = {"table": "calls", "columns": ["visit"], "filters": [dict(zip(("column", "op", "value"), f, strict=True)) for f in filters], "order_by": [{"column": "visit"}], "limit": 500}
        rows = [r["visit"] for r in source.query(request)["rows"]]
        assert rows == [r[0] for r in duck.execute(f"SELECT visit FROM calls WHERE {' AND '.join(said_in_sql(*f) for f in filters)} ORDER BY visit").fetchall()]
        return rows

    assert found(("fee", "gte", 15), ("fee", "lt", 900), ("port", "in", ["bergen", "Bergen"]), ("remark", "ne", "late"))
    assert found(("remark", "eq", "late' OR 'a' = 'a")) == []


def test_case_of_text(source):
    folded = Source(source.tables, source.columns, text_case="ascii", max_rows=500)
    for op, value, exact, any_case in (("contains", "ICE", 3, 6), ("starts_with", "ice", 3, 6), ("contains", "MÖ", 0, 0)):
        request = {"table": "ships", "columns": ["ship"], "filters": [{"column": "name", "op": op, "value": value}], "limit": 500}
        assert (len(source.query(request)["rows"]), len(folded.query(request)["rows"])) == (exact, any_case)


@pytest.mark.parametrize("kind", ["inner", "left"])
@pytest.mark.parametrize("function", list(structured.AGGREGATES))
def test_joined_groups(source, duck, kind, function):
    """Every aggregate over a join, grouped by a column with nulls and ordered by the aggregate."""
    request = {
        "table": "calls",
        "columns": ["ships.flag", "port"],
        "joins": [{"table": "ships", "left": "vessel", "right": "ships.ship", "type": kind}],
        "aggregates": [{"function": function, "column": "fee", "alias": "figure"}, {"function": "count", "column": "*", "alias": "rows"}],
        "group_by": ["port", "ships.flag"],
        "order_by": [{"column": "figure", "direction": "desc"}, {"column": "port"}, {"column": "ships.flag"}],
        "limit": 500,
    }
    got = source.query(request)
    want = duck.execute(
        f"SELECT flag, port, {function}(fee) AS figure, count(*) FROM calls {kind} JOIN ships ON vessel = ship GROUP BY flag, port ORDER BY figure DESC NULLS LAST, port NULLS FIRST, flag NULLS FIRST"
    ).fetchall()
    assert got["columns"] == ["ships.flag", "port", "figure", "rows"] and got["row_count"] == len(want) and not got["truncated"]
    assert [tuple(r.values()) for r in got["rows"]] == want


@pytest.mark.parametrize("direction,nulls", [("asc", "FIRST"), ("desc", "LAST")])
def test_pages_follow_one_another(source, duck, direction, nulls):
    want = [r[0] for r in duck.execute(f"SELECT visit FROM calls ORDER BY fee {direction} NULLS {nulls}, visit").fetchall()]
    got, size = [], 17
    while True:
        request = {"table": "calls", "columns": ["visit", "fee"], "order_by": [{"column": "fee", "direction": direction}, {"column": "visit"}], "limit": size, "offset": len(got)}
        page = source.query(request)
        got += [r["visit"] for r in page["rows"]]
        assert page["truncated"] == (len(got) < len(want)) and page["row_count"] <= size
        if not page["truncated"]:
            break
    assert got == want


def test_budget_of_characters(source):
    for budget in (100, 400, 2000):
        out = Source(source.tables, source.columns, max_rows=500, max_result_chars=budget).query({"table": "ships", "order_by": [{"column": "ship"}], "limit": 24})
        assert out["truncated"] == (out["row_count"] < 24) and [r["ship"] for r in out["rows"]] == list(range(out["row_count"]))
    assert out["row_count"] == 24


FULL = {
    "table": "calls",
    "columns": ["port"],
    "filters": [{"column": "fee", "op": "gt", "value": 1}],
    "joins": [{"table": "ships", "left": "vessel", "right": "ships.ship", "type": "inner"}],
    "aggregates": [{"function": "max", "column": "ships.tons", "alias": "most"}],
    "group_by": ["port"],
    "order_by": [{"column": "most", "direction": "desc"}],
    "limit": 5,
    "offset": 0,
}
ODD = [7, "text", {"a": 1}, None, [[]]]
UNSEEN = ["ships.cabin", "ships.nothing", "nothing", "port; DROP TABLE calls", "", "a\0b", "x" * 300, 5, None, "cabin"]


def refused():
    """FULL with one thing wrong."""
    for name in ("columns", "filters", "joins", "aggregates", "group_by", "order_by"):
        yield from ((f"{name} {v!r:.20}", {**FULL, name: v}) for v in [*ODD, FULL[name] * (structured.MOST[name] + 1)])
        if isinstance(FULL[name][0], dict):
            item = FULL[name][0]
            yield f"{name} with a field more", {**FULL, name: [{**item, "note": 1}]}
            for k in set(item) - {"type", "direction", "value"}:
                yield f"{name} without {k}", {**FULL, name: [{x: y for x, y in item.items() if x != k}]}
    for bad in UNSEEN:
        yield f"columns of {bad!r:.20}", {**FULL, "columns": [bad]}
        yield f"group_by {bad!r:.20}", {**FULL, "columns": [], "group_by": [bad]}
        for name, k in (("filters", "column"), ("joins", "left"), ("joins", "right"), ("aggregates", "column"), ("order_by", "column")):
            yield f"{name} {k} {bad!r:.20}", {**FULL, name: [{**FULL[name][0], k: bad}]}
    for bad in ("secrets", "", None, 3, "calls "):
        yield f"table {bad!r}", {**FULL, "table": bad}
        yield f"joined table {bad!r}", {**FULL, "joins": [{**FULL["joins"][0], "table": bad}]}
    for name, values in (("limit", [0, -1, 501, 1.5, True, "5", None]), ("offset", [-1, 1_000_001, False, "0", 0.0])):
        yield from ((f"{name} {v!r}", {**FULL, name: v}) for v in values)
    for k, name, values in (("op", "filters", ["like", "", None, "EQ"]), ("function", "aggregates", ["median", "COUNT", None]), ("direction", "order_by", ["up", "ASC", None]), ("type", "joins", ["cross", "LEFT", None]), ("alias", "aggregates", ["", None, 5, "port"])):
        yield from ((f"{name} {k} {v!r}", {**FULL, name: [{**FULL[name][0], k: v}]}) for v in values)
    for op in [*structured.COMPARISONS, "in", "not_in", "between", "contains", "starts_with"]:
        wrong = [{"a": 1}, float("inf"), "y" * 10_001]
        wrong += {"eq": [], "ne": []}.get(op, [None])
        wrong += [[], [1] * 501] if op in ("in", "not_in") else [[1], [1, 2, 3]] if op == "between" else [["a"]] if op in structured.COMPARISONS else [5, ["a"]]
        yield from ((f"{op} {v!r:.20}", {**FULL, "filters": [{"column": "fee", "op": op, "value": v}]}) for v in wrong)
    yield "a sum of all", {**FULL, "aggregates": [{"function": "sum", "column": "*", "alias": "most"}]}
    yield "a column out of its group", {**FULL, "columns": ["fee"]}
    yield "an order out of its group", {**FULL, "order_by": [{"column": "fee"}]}
    yield "a table twice", {**FULL, "joins": FULL["joins"] * 2}
    yield "a join of itself", {**FULL, "joins": [{"table": "calls", "left": "vessel", "right": "calls.visit"}]}
    yield "a join without the new table", {**FULL, "joins": [{**FULL["joins"][0], "right": "visit"}]}
    yield "the same name twice", {"table": "calls", "columns": ["port", "port"]}
    yield "nothing selected", {"table": "calls", "columns": []}
    yield "a field more", {**FULL, "having": []}
    yield "no table", {k: v for k, v in FULL.items() if k != "table"}
    yield from ((f"request {v!r:.20}", v) for v in (5, None, "SELECT 1", []))


def test_refusals(source):
    assert source.plan(FULL).columns == ["port", "most"]
    passed = []
    for what, request in refused():
        try:
            source.plan(request)
            passed.append(what)
        except RequestError:
            pass
    assert not passed


def test_sources_refuse_odd_settings(source):
    for settings in ({"max_rows": 0}, {"max_rows": 10_001}, {"max_result_chars": 99}, {"text_case": "upper"}, {"columns": {"docks": ["a"]}}):
        with pytest.raises(RequestError):
            Source(source.tables, **settings)


def test_plan_is_narrow_and_pushed(spark, source, tmp_path):
    path = str(tmp_path / "calls.parquet")
    source.tables["calls"].write.parquet(path)
    plan = Source({"calls": spark.read.parquet(path)}).plan({"table": "calls", "columns": ["visit"], "filters": [{"column": "fee", "op": "gt", "value": 45}], "order_by": [{"column": "visit"}]})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "GreaterThan(fee,45)" in text and "remark" not in text


def test_json_forms(spark):
    values = {"a": [Decimal("1.50"), b"\x00", float("inf")], "b": timedelta(seconds=3), "c": {1: None}, "d": pd.Timestamp("2024-01-02").to_pydatetime()}
    assert json_value(values) == {"a": ["1.50", {"base64": "AA=="}, "inf"], "b": "0:00:03", "c": {"1": None}, "d": "2024-01-02 00:00:00"}
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(5,2)) d, X'00' b, DATE'2024-01-02' t, CAST(NULL AS INT) n, CAST(NULL AS BINARY) m")
    assert json_rows(df).first()[0] == '{"d":"1.50","b":{"base64":"AA=="},"t":"2024-01-02","n":null,"m":null}'


def test_empty_tables(spark):
    s = Source({"e": spark.createDataFrame([], "k long, v string")})
    assert s.query({"table": "e"}) | {"elapsed_ms": 0, "queried_at": ""} == {"source_id": "source", "columns": ["k", "v"], "rows": [], "row_count": 0, "truncated": False, "elapsed_ms": 0, "queried_at": ""}
    assert s.query({"table": "e", "aggregates": [{"function": "count", "column": "*", "alias": "n"}, {"function": "sum", "column": "k", "alias": "s"}]})["rows"] == [{"n": 0, "s": None}]
