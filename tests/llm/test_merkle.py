"""The manifest against a plain tree, with odd rows, and its SQL twin."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import merkle, queries

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return H(*[part(v) for v in (r[0], r[3], r[2], r[4], r[1])])


def tree(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, o in zip(paths, own, strict=True):
            s = o // 8 * 8
            path.append((nodes[s:o], nodes[o + 1 : s + 8]))
        own = [o // 8 for o in own]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subs = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, top = tree([subs[g][0] for g in langs])
    out = []
    for g, above in zip(langs, top, strict=True):
        for r, path in zip(groups[g], subs[g][1], strict=True):
            claimed = (r[0], r[1] and r[1].translate(LOWER), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
            h, whole = leaf(claimed), path + above
            for a, b in whole:
                h = H(*a, h, *b)
            out.append((r[0], leaf(r), subs[g][0], root, H(*[x for a, b in whole for x in a + b]), h, h == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, node string, path string"
OWN = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def made(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "own", "p") for r in rows], SCHEMA)
    out = merkle.manifest(docs, claimed={"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, doubted=F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0)
    return sorted(map(repr, map(tuple, out.select(OWN).collect())))


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_manifest_sizes(spark, count):
    rows = [(i * 37 % 101, f"Text {i}", "en", "s", i) for i in range(count)]
    assert made(spark, rows) == sorted(map(repr, plain(rows)))


def test_manifest_odd_rows(spark):
    rows = [(i, f"T{i}" if i % 5 else None, [None, "", "en", "zh", "é", "Z"][i % 6], None if i % 7 == 0 else "s", i) for i in range(40)]
    rows += [(3, "A", "en", "s", 1)] * 3 + [(3, "B", "en", "s", None), (None, "x", "en", "s", 1), (None, "Y", None, None, None), (-5, "", "en", "", 0), (77, "AbÜ" * 60_000, "en", "s", 1)]
    assert made(spark, rows) == sorted(map(repr, plain(rows)))


def test_many_groups(spark):
    rows = [(i, "Tx", f"l{i}", "s", i) for i in range(70)]  # 70 subroots: three levels
    assert made(spark, rows) == sorted(map(repr, plain(rows)))


def test_several_rounds_of_blocks(spark, monkeypatch):
    """Blocks of 64: 5,000 rows of one group take three rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rows = [(i // 2, f"Same {i % 3}", "en" if i % 10 else "de", "s", 1) for i in range(5000)]
    assert made(spark, rows) == sorted(map(repr, plain(rows)))


def test_unclaimed_rows_are_verified(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i, 0, "", "") for i in range(20)], SCHEMA)
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_query_and_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(queries.oracle_sql()["op11_merkle"])
    names = [d[0] for d in found.description]
    got = queries.op11_merkle(spark, sf)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(found.fetchall()) and sorted(names) == sorted(got.columns)
