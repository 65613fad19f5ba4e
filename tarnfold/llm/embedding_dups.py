"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated by random orthogonal matrices; the signs are its code, and its inner product with
the code's own unit vector is stored as a correction factor. The first rotation is stored in 8 bits a
dimension, too. Code and factor of one vector and the 8-bit form of another give an unbiased estimate of
their inner product, and a confidence bound. Runs of code bits are table keys; vectors that share a key are
compared by these small forms alone. Rows with a pair whose upper bound reaches the threshold come again
with their whole vectors, and such pairs are recomputed in double precision; the others are dropped unseen.

Tables: bits per key grow with the logarithm of the number of distinct vectors and the number of tables
follows from the wanted recall of a pair at the threshold, so a bucket stays small at every size. Equal
vectors are one class with a multiplicity. A bucket above ``tile`` rows is cut into tiles that are
compared two at a time; a pair counts only in the first table that both share, and a group hands on a
row a vector (link count and a root), never its pairs.

Scale: a table costs a key and an id a vector; buckets of several ship codes (an eighth of a byte a
dimension and rotation) and 8-bit forms (a byte a dimension), whole vectors (8 bytes a dimension) only
where the estimate leaves a pair. A comparison holds blocks of ``tile`` x ``_BLOCK`` estimates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, partitions, written


def rotations(dim: int, count: int, seed: int = 20240501) -> np.ndarray:
    """``count`` random orthogonal matrices (dim x dim), the same everywhere."""
    out = []
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


class Coder:
    def __init__(self, dim: int, bits: int, tables: int):
        self.dim, self.bits, self.tables = dim, bits, tables
        self.each = max(1, dim // bits)
        self.matrices = rotations(dim, -(-tables // self.each))
        self.weights = 1 << np.arange(min(bits, 62), dtype=np.int64)

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code bits (rows x rotations x dim), the first rotation's correction factors, and it in 8 bits with its scale."""
        bits = np.stack([unit @ m.T >= 0 for m in self.matrices], axis=1)
        turned = unit @ self.matrices[0].T
        return bits, np.abs(turned).sum(1) / math.sqrt(self.dim), turned

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """Table keys (rows x tables) of code bits; with fewer dimensions than bits, all signs are the key."""
        out = np.empty((len(bits), self.tables), np.int64)
        for t in range(self.tables):
            k, at = divmod(t, self.each)
            piece = bits[:, k, at * self.bits : (at + 1) * self.bits]
            out[:, t] = piece @ self.weights[: piece.shape[1]]
        return out

    def unpacked(self, packed: list[bytes]) -> np.ndarray:
        flat = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)
        return flat[:, : len(self.matrices) * self.dim].reshape(len(packed), len(self.matrices), self.dim)


_BLOCK = 128


def quantized(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors in 8 bits, and the scale of each."""
    scale = np.abs(turned).max(1) / 127
    return np.rint(turned / scale[:, None]).astype(np.int8), scale


def bound(factor: np.ndarray, dim: int, confidence: float) -> np.ndarray:
    """How far a row's estimates may be off: the code's share, and that of 8 bits.

    ``confidence`` counts the deviations of any pair. At a cosine c they shrink by sqrt(1 - c * c), so 1.9 is about 6 at 0.95.
    """
    f = np.clip(factor, 1e-9, 1.0)
    return confidence * np.sqrt((1 - f * f) / (f * f) / max(1, dim - 1)) + 0.5 / 127 / f


def estimated(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products (signs +1, -1 against rotated vectors), and each row's bound."""
    dim = signs.shape[1]
    found = (signs @ turned.T) / (math.sqrt(dim) * np.clip(factor, 1e-9, 1.0)[:, None]).astype(signs.dtype)
    return found, bound(factor, dim, confidence)


def _raw(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows: list[list] = [[], [], [], []]
            for v in column.to_pylist():
                a = np.array(v if v is not None and None not in v else [], np.float64)
                if not len(a) or not np.isfinite(a).all() or not a.any():
                    row = (None, None, None, None)
                else:
                    data = (a + 0.0).tobytes()
                    d = xxhash.xxh3_128_digest(data)
                    row = (len(a), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), data)
                for c, x in zip(rows, row, strict=True):
                    c.append(x)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=["k", "dim", "h1", "h2", "v"])

    rows = vectors.select(vectors[key].cast("long").alias("k"), vectors[embedding].cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "k long, dim int, h1 long, h2 long, v binary")


def _unit(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    scaled = v / np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay finite
    return v, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, miss: float = 1e-4, confidence: float = 1.9, tile: int = 1024
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Links are pairs with cosine >= threshold in double precision among vectors of equal length. ``miss``
    is the share of pairs exactly at the threshold that no table may bring together. A vector that is
    null, empty, zero or holds a null or non-finite component links with nothing. Rows that repeat a key
    are vectors of their own for the counts and one node for the components; a null key has no links and no component and is kept.
    An empty table gives no rows; other columns are ignored.
    """
    raw = written(_raw(vectors, key, embedding), "vectors")
    spark = vectors.sparkSession
    usable = raw.where("v is not null and k is not null")
    classes = written(usable.groupBy("dim", "h1", "h2").agg(F.min("k").alias("k"), F.count("*").alias("many"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    same_bit = 1 - math.acos(threshold) / math.pi
    plan = {}
    for dim, n in sizes.items():
        bits = min(dim, max(8, round(math.log2(max(n, 2) / 8))))
        plan[dim] = (bits, math.ceil(math.log(miss) / math.log(1 - same_bit**bits)))
    found = None
    if plan:
        found, made = _compare(classes, plan, threshold, confidence, tile, partitions(spark))
        found = written(found, "vector-links")
        discard(*made)
    counts = found.groupBy("id").agg(F.sum("links").alias("links")) if found is not None else spark.createDataFrame([], "id long, links long")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")) if found is not None else spark.createDataFrame([], "a long, b long")
    # a key of several vectors is one node
    several = usable.groupBy("k").agg(F.min(F.struct("dim", "h1", "h2")).alias("lo"), F.max(F.struct("dim", "h1", "h2")).alias("hi")).where("lo != hi").select("k")
    of_key = usable.select("k", "dim", "h1", "h2").join(several, "k").distinct().join(classes.select("dim", "h1", "h2", "id"), ["dim", "h1", "h2"]).select("k", "id")
    one = of_key.groupBy("k").agg(F.min("id").alias("a"))
    groups = components(edges.unionByName(of_key.join(one, "k").select("a", F.col("id").alias("b"))))
    least = groups.join(classes.select("id", "k"), "id").groupBy("component").agg(F.min("k").alias("label"))
    named = groups.join(least, "component").select("id", "label")
    counted = classes.join(counts, "id", "left").join(named, "id", "left")
    labels = counted.select("h1", "h2", "dim", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("label", "k").alias("component"))
    out = raw.select("k", "h1", "h2", "dim").join(labels, ["h1", "h2", "dim"], "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    links = F.when(F.col("k").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    out = written(out.select(F.col("k").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(True)).alias("kept")), "near-vectors")
    discard(raw, classes, groups, *([found] if plan else []))
    return out


_GROUP = ["dim", "t", "key", "i", "j"]


def _compare(classes, plan, threshold, confidence, tile, parts):
    """``id, links, root`` of the rows of each tile, and tables to discard."""

    def code_rows(batches):
        coders: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                dims = cut.column(1).to_pylist()
                for dim in sorted(set(dims)):
                    coder = coders.setdefault(dim, Coder(dim, *plan[dim]))
                    part = cut.take(pa.array([i for i, d in enumerate(dims) if d == dim], pa.int32()))
                    bits, factor, turned = coder.codes(_unit(part.column(2).to_pylist())[1])
                    small, scale = quantized(turned)
                    packed = np.packbits(bits.reshape(len(bits), -1), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(scale), pa.array(list(coder.keys(bits)), pa.list_(pa.int64()))],
                        names=["id", "dim", "code", "factor", "small", "scale", "keys"],
                    )

    coded = classes.select("id", "dim", "v").mapInArrow(code_rows, "id long, dim int, code binary, factor double, small binary, scale double, keys array<long>")
    coded = written(coded, "vector-codes")
    light = coded.select("id", "dim", F.posexplode("keys").alias("t", "key"))
    buckets = light.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = (
        light.join(buckets, ["dim", "t", "key"])
        .withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("own", own)
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("id", "dim", "t", "key", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    )
    forms = ["code", "factor", "small", "scale"]

    def sorted_tiles(df):
        return df.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)

    def likely(batches):
        coders: dict = {}
        for dim, marks, starts, rows in _tiles(batches):
            coder = coders.setdefault(dim, Coder(dim, *plan[dim]))
            near = np.zeros(rows.num_rows, bool)
            for a, b, _ in _Block(coder, rows, threshold, confidence).pairs(marks, starts):
                near[a] = near[b] = True
            if near.any():
                yield from rows.select([*_GROUP, "own", "id"]).take(np.flatnonzero(near)).combine_chunks().to_batches()

    small = dealt.join(coded.select("id", *forms), "id").select(*_GROUP, "own", "id", *forms)
    near = written(sorted_tiles(small).mapInArrow(likely, "dim int, t int, key long, i int, j int, own int, id long"), "vector-pairs")

    def exact(batches):
        coders: dict = {}
        for dim, marks, starts, rows in _tiles(batches):
            coder = coders.setdefault(dim, Coder(dim, *plan[dim]))
            if found := _exact(coder, rows, marks, starts, threshold, confidence):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "links", "root"])

    whole = near.join(coded.select("id", *forms), "id").join(classes.select("id", "many", "v"), "id").select(*_GROUP, "own", "id", *forms, "many", "v")
    return sorted_tiles(whole).mapInArrow(exact, "id long, links long, root long"), [coded, near]


def _tiles(batches, least: int = 4096):
    """(dim, marks, first rows, rows) of whole tiles of a sorted stream, many small ones together; marks are those of ``_GROUP``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows > least:
            marks = np.stack([held.column(g).to_numpy() for g in _GROUP])
            first = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)]))
            if first[-1] == 0:  # one tile, which may go on
                break
            end = first[first >= least][0] if first[-1] >= least else first[-1]
            yield from _by_dim(marks[:, :end], first[first < end], held.slice(0, end))
            held = held.slice(end)
        held = held.combine_chunks()
    if held is not None and held.num_rows:
        marks = np.stack([held.column(g).to_numpy() for g in _GROUP])
        yield from _by_dim(marks, np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)])), held)


def _by_dim(marks: np.ndarray, first: np.ndarray, rows: pa.Table):
    for dim in np.unique(marks[0]).tolist():
        here = marks[0] == dim  # rows of a vector length need not be neighbours
        if here.all():
            yield dim, marks, first, rows.combine_chunks()
        else:
            at = np.flatnonzero(here)
            yield dim, marks[:, at], np.flatnonzero(np.isin(at, first)), rows.take(at).combine_chunks()


class _Block:
    """The small forms of some rows, and the pairs that they do not rule out."""

    def __init__(self, coder: Coder, rows: pa.Table, threshold: float, confidence: float):
        n = rows.num_rows
        self.threshold, self.own = threshold, rows.column("own").to_numpy()
        bits = coder.unpacked(rows.column("code").to_pylist())
        self.keys = coder.keys(bits)
        factor = np.clip(rows.column("factor").to_numpy(), 1e-9, 1.0)
        self.off = bound(factor, coder.dim, confidence)
        self.signs = (bits[:, 0].astype(np.float32) * 2 - 1) / (math.sqrt(coder.dim) * factor.astype(np.float32))[:, None]
        self.turned = np.frombuffer(b"".join(rows.column("small").to_pylist()), np.int8).reshape(n, -1) * rows.column("scale").to_numpy().astype(np.float32)[:, None]

    def pairs(self, marks: np.ndarray, starts: np.ndarray, small: int = 32):
        """(rows, rows, a tile's first row or None): pairs of tiles whose upper bound reaches the threshold and whose first common table is their own."""
        sizes = np.diff(np.append(starts, marks.shape[1]))
        one = marks[3, starts] == marks[4, starts]
        for size in np.unique(sizes[one & (sizes <= small) & (sizes > 1)]).tolist():  # all small tiles of a size at once
            x, y = np.triu_indices(size, 1)
            of = starts[one & (sizes == size)]
            step = max(1, 200_000 // len(x))
            for at in range(0, len(of), step):
                a, b = (of[at : at + step, None] + x).ravel(), (of[at : at + step, None] + y).ravel()
                near = np.einsum("ij,ij->i", self.signs[a], self.turned[b]) + self.off[a] >= self.threshold
                yield *self._first(a[near], b[near], marks[1, a[near]]), None
        for s, n, within in zip(starts.tolist(), sizes.tolist(), one.tolist(), strict=True):
            if n < 2 or within and n <= small:
                continue
            of, t = np.arange(s, s + n), marks[1, s]
            left, right = (of, of) if within else (of[self.own[of] == marks[3, s]], of[self.own[of] == marks[4, s]])
            for at in range(0, len(left), _BLOCK):
                a = left[at : at + _BLOCK]
                near = self.signs[a] @ self.turned[right].T >= (self.threshold - self.off[a])[:, None]
                if within:
                    near &= right[None, :] > a[:, None]
                x, y = np.nonzero(near)
                yield *self._first(a[x], right[y], np.full(len(x), t)), s

    def _first(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(a), bool)
        for earlier in range(int(t.max(initial=0))):
            new &= (self.keys[a, earlier] != self.keys[b, earlier]) | (t <= earlier)
        return a[new], b[new]


def _exact(coder: Coder, rows: pa.Table, marks: np.ndarray, starts: np.ndarray, threshold: float, confidence: float):
    """(id, linked vectors, root) of whole tiles, from exact inner products of the pairs that the estimates leave."""
    ids, many = rows.column("id").to_numpy(), rows.column("many").to_numpy()
    _, unit = _unit(rows.column("v").to_pylist())
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    ends = np.append(starts, len(ids))
    for a, b, tile in _Block(coder, rows, threshold, confidence).pairs(marks, starts):
        of = slice(None) if tile is None else slice(tile, ends[np.searchsorted(ends, tile) + 1])
        step = max(256, 4_000_000 // coder.dim)
        for cut in range(0, len(a), step):
            x, y = a[cut : cut + step], b[cut : cut + step]
            same = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold  # double precision
            x, y = x[same], y[same]
            np.add.at(links, x, many[y])
            np.add.at(links, y, many[x])
            apart = root[x] != root[y]
            _join(root, x[apart], y[apart], of)
    hit = np.flatnonzero(links)
    return (ids[hit], links[hit], ids[root[hit]]) if len(hit) else None


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray, of: slice) -> None:
    """Lowers ``root`` (a row number for each row, roots their own) so that linked rows share it; ``of`` holds them all."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root[of]] != root[of]).any():
            root[of] = root[root[of]]
        left = root[a] != root[b]
        a, b = a[left], b[left]
