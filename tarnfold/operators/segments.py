"""Vector segments behind numbered manifests: built for what has none, retired and merged by policy, searched by cells or whole.

A pass writes one folder, parted by segment, and claims the next manifest, which lists the segments that hold. Segments are never
changed, so a reader that took its list once is not disturbed; of two writers that start from the same list one
has to start again from the other's. What reaches the driver is a row a segment and a row a cell.

Each pass puts its vectors in cells around centres (spherical k-means on a bounded sample; every vector is in its nearest cell) and deals
segments by ranges of cells, sorted, so that a scan for some cells prunes folders, then row groups. A search reads the ``probes`` cells whose
centres are nearest and ranks their vectors exactly; by default as many of each pass as its sample needed to find 97 of 100 of its own ten nearest,
few where vectors lie in clusters and most where they do not. A cell's radius (largest angle to its centre) bounds how near its vectors can be:
with ``certain`` every cell that may hold a nearer one is read as well, so that the page is the exact one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.maintain import Snapshot, compaction_plan, live_ratio, missing_members
from tarnfold.operators.search import nearest, ranked

SCHEMA = "chunk_id long, hash string, embedding array<float>, cell int, angle float, pass string, segment int"
#: Of a pass: cells, vectors of which the centres are learned, rounds of learning, and segments at most.
MOST_CELLS, SAMPLE, ROUNDS, MOST_SEGMENTS = 4096, 20_000, 8, 64
#: The cell of vectors without a direction, which are at distance 1 from all.
NOWHERE = -1
_FINE = {"parquet.block.size": str(4 << 20), "parquet.page.row.count.limit": "1000"}


@dataclass(frozen=True)
class Cells:
    """The cells of all passes of a manifest: pass, number, centre (unit), radius (angle), vectors, and how many of its pass a search needs."""

    passes: list[str]
    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    needed: np.ndarray

    def chosen(self, angles: np.ndarray, probes: int | None) -> np.ndarray:
        """Which cells each query reads first: its ``probes`` nearest, or (None) as many of each pass as that needs."""
        out = np.zeros(angles.shape, bool)
        groups = [np.arange(len(self.passes))] if probes is not None else [np.flatnonzero(np.array(self.passes) == p) for p in sorted(set(self.passes))]
        for own in groups:
            n = int(self.needed[own[0]]) if probes is None else probes
            first = own[np.argsort(angles[:, own], axis=1, kind="stable")[:, :n]]
            np.put_along_axis(out, first, True, 1)
        return out

    def angles(self, queries: np.ndarray) -> np.ndarray:
        """Angles between the queries (unit) and the centres; a right angle to the cell of vectors without direction."""
        out = np.arccos(np.clip(queries @ self.centres.T, -1, 1))
        out[:, self.numbers == NOWHERE] = np.pi / 2
        return out

    def nearest_possible(self, angles: np.ndarray) -> np.ndarray:
        """The least distance that a vector of each cell can have."""
        return 1 - np.cos(np.maximum(0, angles - self.radii))


def learn(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (unit) of spherical k-means; a cell that empties takes the vector that is worst off."""
    v = _unit(vectors)
    v = v[np.abs(v).sum(1) > 0]
    if not len(v):
        return np.zeros((0, vectors.shape[1]))
    centres = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
    for _ in range(rounds):
        near = v @ centres.T
        own = near.argmax(1)
        worst = iter(near.max(1).argsort())
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        for k in np.flatnonzero(np.abs(total).sum(1) < 1e-12):
            total[k] = v[next(worst)]
        centres = _unit(total)
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, share: float = 0.97, limit: int = 10, queries: int = 200) -> int:
    """How many nearest cells hold ``share`` of the ``limit`` nearest, within the sample, of some of its vectors."""
    v = _unit(sample)
    v = v[np.abs(v).sum(1) > 0]
    if not len(centres) or not len(v):
        return 1
    own = (v @ centres.T).argmax(1)
    q = v[np.linspace(0, len(v) - 1, min(queries, len(v))).astype(int)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in each query's order
    top = np.argpartition(-(q @ v.T), min(limit, len(v)) - 1, axis=1)[:, :limit]
    at = np.sort(np.take_along_axis(place, own[top], 1).ravel())
    return int(at[max(0, int(np.ceil(share * len(at))) - 1)]) + 1


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


class VectorSegments:
    """Segments below a folder of at most about ``capacity`` rows (chunk_id, hash, embedding).

    ``chunks``: chunk_id, hash, semantic; a row of a segment is live while a semantic chunk has its chunk_id and hash.
    Chunks without a key or hash are in no segment. ``vectors``: hash, embedding, one a hash.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = 20_000, ratio: float = 0.3, most: int = 8):
        if capacity < 1 or most < 1 or not 0 < ratio <= 1:
            raise ValueError("capacity and most from 1, a ratio above 0 and up to 1")
        self.spark, self.capacity, self.ratio, self.most = spark, capacity, ratio, most
        self.manifests = Snapshot(spark, path)
        self.folder = f"{self.manifests.base}/passes"
        self._known: tuple[int, Cells] | None = None

    def rows(self) -> DataFrame:
        """All rows of the segments that hold now, with their pass and segment."""
        return self._rows(self.manifests.manifest())

    def _rows(self, manifest: dict) -> DataFrame:
        held: dict[str, list[int]] = {}
        for made, number, _ in manifest.get("segments", []):
            held.setdefault(made, []).append(number)
        if not held:
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).option("basePath", self.folder).parquet(*[f"{self.folder}/pass={p}" for p in sorted(held)])
        return found.where(reduce(lambda a, b: a | b, [(F.col("pass") == p) & F.col("segment").isin(n) for p, n in sorted(held.items())]))

    def live(self, chunks: DataFrame) -> DataFrame:
        return _alive(self.rows(), chunks)

    def add(self, chunks: DataFrame, vectors: DataFrame) -> dict:
        """Segments for the eligible chunks that have a vector and are in none; the manifest that holds then."""

        def change(manifest):
            missing = missing_members(chunks, vectors, self._rows(manifest))
            return missing.join(vectors.select("hash", "embedding"), "hash"), manifest.get("segments", [])

        return self._publish(change)

    def compact(self, chunks: DataFrame) -> dict:
        """Drops segments without a live row; writes those anew that have lost too many, and the smallest where there are too many."""

        def change(manifest):
            rows = self._rows(manifest).withColumn("name", F.concat_ws("/", "pass", "segment"))
            plan = compaction_plan(live_ratio(rows.withColumn("segment", F.col("name")), chunks), self.ratio, self.most, self.capacity)
            again = plan["rewrite"] + plan["merge"]
            kept = [s for s in manifest.get("segments", []) if f"{s[0]}/{s[1]}" not in {*again, *plan["drop"]}]
            return _alive(rows.where(F.col("name").isin(again)), chunks) if again else None, kept

        return self._publish(change)

    def _publish(self, change: Callable[[dict], tuple[DataFrame | None, list]], tries: int = 20) -> dict:
        for _ in range(tries):
            old = self.manifests.manifest()
            rows, kept = change(old)
            made = f"p{uuid.uuid4().hex}"
            written = self._write(rows, made) if rows is not None else []
            if not written and kept == old.get("segments", []):
                self._delete(made)
                return old
            new = {"current": None, "previous": None, "generation": old["generation"] + 1, "segments": kept + written, "before": old.get("segments", [])}
            if self.manifests._claim(new):
                return new
            self._delete(made)
        raise RuntimeError("other writers were always first")

    def _write(self, rows: DataFrame, made: str) -> list[list]:
        cut = rows.select(F.col("chunk_id").cast("long"), "hash", F.col("embedding").cast("array<float>").alias("embedding"))
        raw = f"{self.manifests.base}/raw-{made}"
        cut.write.parquet(raw)  # once: what is missing is a join of all chunks
        held = self.spark.read.schema(cut.schema).parquet(raw)
        try:
            return self._dealt(held, held.count(), made)
        finally:
            self.manifests.files.delete(self.manifests._path(f"raw-{made}"), True)

    def _dealt(self, held: DataFrame, count: int, made: str) -> list[list]:
        if not count:
            return []
        sample = held.orderBy(F.xxhash64("hash", "chunk_id")).select("embedding").limit(SAMPLE).toArrow()
        known = _matrix(sample.column(0))
        centres = learn(known, min(MOST_CELLS, max(1, int(count**0.5))))
        needed = needed_probes(known, centres)

        def assign(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _unit(_matrix(batch.column(2)))
                near = v @ centres.T if len(centres) else np.zeros((len(v), 1))
                own, lost = near.argmax(1), np.abs(v).sum(1) == 0
                cell = np.where(lost, NOWHERE, own).astype(np.int32)
                angle = np.where(lost, 0, np.arccos(np.clip(near[np.arange(len(v)), own], -1, 1))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["chunk_id", "hash", "embedding", "cell", "angle"])

        many = -(-count // max(self.capacity, -(-count // MOST_SEGMENTS)))
        dealt = held.mapInArrow(assign, "chunk_id long, hash string, embedding array<float>, cell int, angle float").repartitionByRange(many, "cell", "chunk_id")
        dealt = dealt.withColumn("segment", F.spark_partition_id()).sortWithinPartitions("segment", "cell", "chunk_id")
        path = f"{self.folder}/pass={made}"
        dealt.write.options(**_FINE).partitionBy("segment").parquet(path)
        written = self.spark.read.schema(SCHEMA).option("basePath", self.folder).parquet(path)
        facts = written.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
        nowhere = [0.0] * centres.shape[1]
        cells = [(r.cell, centres[r.cell].tolist() if r.cell >= 0 else nowhere, float(r.radius), r.n, needed) for r in facts]
        self.spark.createDataFrame(cells, "cell int, centre array<double>, radius double, n long, needed int").coalesce(1).write.parquet(f"{self.manifests.base}/cells/pass={made}")
        sizes = written.groupBy("segment").agg(F.count("*").alias("n"))
        return sorted([made, r.segment, r.n] for r in sizes.collect())

    def _delete(self, made: str) -> None:
        for folder in ("passes", "cells"):
            self.manifests.files.delete(self.manifests._path(folder, f"pass={made}"), True)

    def cells(self, manifest: dict) -> Cells:
        """All cells of a manifest's passes, best read once a manifest."""
        if self._known is None or self._known[0] != manifest["generation"]:
            passes = sorted({s[0] for s in manifest.get("segments", [])})
            root = f"{self.manifests.base}/cells"
            rows = self.spark.read.option("basePath", root).parquet(*[f"{root}/pass={p}" for p in passes]).collect() if passes else []
            dim = max((len(r.centre) for r in rows), default=0)
            centres = np.array([r.centre or [0.0] * dim for r in rows]).reshape(len(rows), dim)
            self._known = (manifest["generation"], Cells([r["pass"] for r in rows], np.array([r.cell for r in rows], int), centres, np.array([r.radius for r in rows]) + 1e-6, np.array([r.n for r in rows], int), np.array([r.needed for r in rows], int)))
        return self._known[1]

    def _in(self, manifest: dict, cells: Cells, chosen: np.ndarray) -> DataFrame:
        """The rows of these cells: the scan's filters name them."""
        by: dict[str, list[int]] = {}
        for k in chosen:
            by.setdefault(cells.passes[k], []).append(int(cells.numbers[k]))
        tests = [(F.col("pass") == p) & F.col("cell").isin(sorted(n)) for p, n in sorted(by.items())]
        return self._rows(manifest).where(reduce(lambda a, b: a | b, tests, F.lit(False)))

    def search(self, query: list[float], limit: int, chunks: DataFrame, where: Column | None = None, probes: int | None = None, certain: bool = False, whole: bool = False) -> DataFrame:
        """``chunk_id, distance`` of the nearest live chunks, of those that ``where`` (over the columns of ``chunks``) lets through.

        The nearest ``probes`` cells are read (by default as many as the passes need), more of them where they hold too few live chunks,
        with ``certain`` all that can hold a nearer one, and with ``whole`` every vector is scored.
        """
        scope = chunks if where is None else chunks.where(where)
        manifest = self.manifests.manifest()
        if whole or not np.abs(np.asarray(query, float)).sum():
            return nearest(_alive(self._rows(manifest), scope), query, limit, "chunk_id")
        cells, page = self.cells(manifest), []
        if cells.passes:
            angles = cells.angles(_unit([query]))
            first, least = cells.chosen(angles, probes)[0], cells.nearest_possible(angles)[0]
            left = np.lexsort((angles[0], ~first))  # those to be read first, then the others by angle
            n = int(first.sum())
            while len(left):
                part, left, n = left[:n], left[n:], 4 * n
                found = nearest(_alive(self._in(manifest, cells, part), scope), query, limit, "chunk_id").collect()
                page = sorted([*page, *[(r.distance, r.chunk_id) for r in found]])[:limit]
                if len(page) >= limit:
                    left = left[least[left] <= page[-1][0] + 1e-6] if certain else left[:0]
                    n = len(left)
        return self.spark.createDataFrame([(k, d) for d, k in page], "chunk_id long, distance double")

    def search_batch(self, queries: np.ndarray, limit: int, chunks: DataFrame, probes: int | None = None, certain: bool = False) -> DataFrame:
        """``query_no, chunk_id, distance, rank`` of many queries (a bounded matrix): each cell is read once and meets the queries that probe it."""
        manifest, q = self.manifests.manifest(), _unit(queries)
        cells = self.cells(manifest)
        empty = self.spark.createDataFrame([], "query_no int, chunk_id long, distance double, rank int")
        if not len(cells.passes) or not len(q):
            return empty
        angles = cells.angles(q)
        wanted = cells.chosen(angles, probes)
        wanted |= (np.abs(q).sum(1) == 0)[:, None]  # a query without direction is as far from all
        top = self._scored(manifest, cells, q, wanted, limit, chunks)
        if certain:
            held = {r.query_no: (r.n, r.worst) for r in top.groupBy("query_no").agg(F.count("*").alias("n"), F.max("distance").alias("worst")).collect()}  # a row a query
            worst = np.array([held[i][1] if i in held and held[i][0] >= limit else 2.0 for i in range(len(q))])
            more = ~wanted & (cells.nearest_possible(angles) <= worst[:, None] + 1e-6)
            if more.any():
                both = top.drop("rank").unionByName(self._scored(manifest, cells, q, more, limit, chunks).drop("rank"))
                top = ranked(both, F.col("distance"), "chunk_id", "query_no").where(F.col("rank") < limit)
        return top

    def _scored(self, manifest: dict, cells: Cells, q: np.ndarray, wanted: np.ndarray, limit: int, chunks: DataFrame) -> DataFrame:
        at = {(p, int(n)): k for k, (p, n) in enumerate(zip(cells.passes, cells.numbers, strict=True))}

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, v = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
                own = np.array([at[x] for x in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)])
                keep: list[list] = [[] for _ in range(3)]
                for k in np.unique(own):
                    rows, asked = np.flatnonzero(own == k), np.flatnonzero(wanted[:, k])
                    d = np.round(1 - q[asked] @ v[rows].T, 6) + 0.0
                    for i, row in zip(asked, d, strict=True):
                        n = min(limit, len(row))
                        pick = np.flatnonzero(row <= np.partition(row, n - 1)[n - 1])
                        pick = pick[np.lexsort((ids[rows[pick]], row[pick]))][:n]
                        for column, values in zip(keep, ([i] * len(pick), ids[rows[pick]], row[pick]), strict=True):
                            column.append(np.asarray(values))
                parts = [np.concatenate(c) if c else np.zeros(0) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(parts, (np.int32, np.int64, np.float64), strict=True)], names=["query_no", "chunk_id", "distance"])

        rows = _alive(self._in(manifest, cells, np.flatnonzero(wanted.any(0))), chunks).select("chunk_id", "embedding", "cell", "pass")
        part = rows.mapInArrow(run, "query_no int, chunk_id long, distance double")
        return ranked(part, F.col("distance"), "chunk_id", "query_no").where(F.col("rank") < limit)

    def collect_garbage(self) -> list[str]:
        """Deletes passes of which neither the last manifest nor the one before it lists a segment. Run it while no pass is being written."""
        manifest, gone = self.manifests.manifest(), []
        used = {s[0] for s in [*manifest.get("segments", []), *manifest.get("before", [])]}
        root = self.manifests._path("passes")
        for found in self.manifests.files.listStatus(root) if self.manifests.files.exists(root) else []:
            made = found.getPath().getName().removeprefix("pass=")
            if made not in used:
                self._delete(made)
                gone.append(made)
        self.manifests.collect_garbage()
        return gone


def _alive(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks.where("semantic").select("chunk_id", "hash"), ["chunk_id", "hash"], "left_semi")
