from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import sync


def read_all(rows, key, updated=None, size=3, state=None, now=0.0, grow=None):
    t, seen, state, pages = sync.TableSync(rows, key, updated, size), [], state or sync.Checkpoint(), 0
    while True:
        page, state, over = t.page(state, now)
        seen += [r[key] for r in page.collect()]
        pages += 1
        if grow is not None and pages == 1:
            t.rows = grow
        state = sync.Checkpoint.from_json(state.to_json())
        for name in ("cursor", "boundary", "watermark"):
            v = getattr(state, name)
            setattr(state, name, tuple(v) if isinstance(v, list) else v)
        if over:
            return seen, state, pages


def test_full_cycle_reads_each_row_once_and_ends(spark):
    rows = spark.range(1, 12)
    grown = spark.range(1, 40)
    seen, state, pages = read_all(rows, "id", grow=grown)
    assert seen == list(range(1, 12)) and pages == 4 and state.boundary is None


def test_incremental_replays_ties_of_the_watermark(spark):
    rows = spark.createDataFrame([(i, i // 4) for i in range(10)], "id long, u long")
    seen, state, _ = read_all(rows, "id", "u")
    assert seen == list(range(10)) and state.watermark == (2, 9)
    more = rows.unionByName(spark.createDataFrame([(10, 2), (11, 3), (12, 0)], "id long, u long"))
    seen, state, _ = read_all(more, "id", "u", state=state, now=10.0)
    assert seen == [8, 9, 10, 11] and state.watermark == (3, 11)  # the backdated row waits for a full pass
    assert sync.choose_mode("u", state, 5000.0, 3600.0) == "full"


def test_empty_source(spark):
    seen, state, pages = read_all(spark.range(0), "id")
    assert seen == [] and pages == 1


def test_scalars():
    assert sync.sync_scalar(Decimal("1.5")) == "1.5" and sync.sync_scalar(date(2024, 1, 2)) == "2024-01-02"
    for bad in (None, True, b"x", float("nan"), "x" * 3000, [1]):
        with pytest.raises(ValueError):
            sync.sync_scalar(bad)


def test_documents_and_keys(spark):
    import hashlib

    rows = spark.createDataFrame([(1, "a", None), (2, 'q"', "b")], "id long, x string, y string")
    got = sync.as_documents(rows, "s", "t", "id", ["x", "y"]).orderBy("row_id").collect()
    assert [r.text for r in got] == ["x: a", 'x: q"\ny: b']
    assert got[0].key == hashlib.sha256(b'["s", "t", "id", 1]').hexdigest() and got[1].version == hashlib.sha256(got[1].text.encode()).hexdigest()


def test_preflight_and_proposal(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", "x"), (3, None, "c", "y")], "id long, dup long, body string, u string")
    assert sync.preflight(rows, "id", ["body"])["ok"]
    assert sync.preflight(rows, "dup", ["body"])["code"] == "null_key"
    assert sync.preflight(rows.where("dup is not null"), "dup", ["body"])["code"] == "duplicate_key"
    assert sync.preflight(rows, "nope", ["body"])["code"] == "column_unavailable"
    assert sync.preflight(rows, "id", ["body"], "u")["code"] == "null_watermark"
    assert sync.preflight(rows.withColumn("m", F.create_map(F.lit(1), F.lit(2))), "m", ["body"])["code"] == "unordered_type"
    p = sync.proposal([{"table": "t", "key": "id", "texts": ["body"]}], {"t": rows})
    assert p["allowed_columns"] == {"t": ["id", "body"]} and p["notes"]
    with pytest.raises(ValueError):
        sync.proposal([{"table": "t", "key": "id", "texts": ["zzz"]}], {"t": rows})
    r = sync.recommend({"t": rows}, spark).first()
    assert r["keys"] == ["id"] and r["texts"] == ["body", "u"]
    wide = spark.range(1).select("id", *[F.lit("x").alias(f"c{i}") for i in range(300)])
    many = sync.recommend({f"t{i:03}": wide for i in range(70)}, spark).collect()
    assert len(many) == 70 and all(len(r.texts) == 300 for r in many)  # none is left out


def test_bounded_snapshot_says_whether_it_is_whole(spark):
    part, complete = sync.bounded_snapshot(spark.range(10), "id", 10)
    assert part.count() == 10 and complete.first()[0]
    assert not sync.bounded_snapshot(spark.range(11), "id", 10)[1].first()[0]
