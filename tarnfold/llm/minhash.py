"""Near-duplicate documents by HyperMinHash.

One hash of a shingle picks a bucket and gives a value; a bucket keeps its smallest value as a count of
leading zeros and some mantissa bits (16 bits a register). Empty buckets borrow from a filled one, in an
order of their own, so that short texts band as well as long ones. Bands of registers give candidates;
a Jaccard estimate corrected for chance collisions of registers drops those that are far below the
threshold; the rest is verified on the full shingle sets.

Groups are never expanded to pairs: documents with equal sets become one class; in each band bucket every
class is first compared with the bucket's smallest, a pair a member. Buckets that still hold several
components are compared in tiles of bounded rows and shingles, inside tasks, component against component:
by sketches first, then on the sets of those that the sketches leave. No link between components is lost,
and only links leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, grouped, partitions, raw_texts, written

REGISTERS = 128
BAND = 4
MANTISSA = 10
_SHIFT = np.uint64(64 - 7)


class Shingles:
    """Hashed sets of runs of ``width`` words: lower case (A-Z only), cut at ASCII white space."""

    def __init__(self, width: int):
        self.width = width

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes; of a text with fewer words, the whole sequence as one."""
        words = text.lower().split()
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words) + 1)] if words else [], np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(h) - self.width + 1
        acc = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, self.width):
            acc = ((acc << np.uint64(27)) | (acc >> np.uint64(37))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + n]
        acc ^= acc >> np.uint64(33)
        acc *= np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(33)
        acc *= np.uint64(0xC4CEB9FE1A85EC53)
        acc ^= acc >> np.uint64(33)
        return np.unique(acc)


def _borrow_order() -> np.ndarray:
    return np.stack([np.random.default_rng(1000 + j).permutation(REGISTERS) for j in range(REGISTERS)])


_ORDER = _borrow_order()
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << _SHIFT


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Registers after borrowing (16 bits each) and the mask of buckets that are filled of themselves."""
    at = np.searchsorted(hashes, _EDGES)
    filled = np.append(at[1:], len(hashes)) > at
    x = hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(64) - _SHIFT
    exponent = np.frexp(x.astype(np.float64))[1]  # may round up at 2**k: a register off by one, alike for equal values
    zeros = np.clip(64 - exponent, 0, 57).astype(np.uint64)
    zeros = np.where(x >> (np.uint64(63) - zeros) == 0, zeros + np.uint64(1), zeros)
    zeros = np.minimum(zeros, np.uint64(57))
    mantissa = (x << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    registers = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    if not filled.all():
        lender = _ORDER[np.arange(REGISTERS), filled[_ORDER].argmax(1)]
        registers = np.where(filled, registers, registers[lender])
    return registers.astype("<u2").tobytes(), np.packbits(filled).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches, corrected for chance, and the buckets they rest on."""
    either, both = (fa | fb).sum(1), (fa & fb).sum(1)
    equal = ((a == b) & fa & fb).sum(1)
    octave = np.arange(58)

    def share(n):
        k = (n / REGISTERS)[:, None]
        return (1 - 2.0 ** -(octave + 1)) ** k - (1 - 2.0**-octave) ** k

    chance = (share(na) * share(nb)).sum(1) / (1 << MANTISSA)
    return (equal - chance * both) / np.maximum(either - chance * both, 1e-9), either


def _signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], [], [], []]
                for t in raw_texts(part.column(1)):
                    h = shingles.of(t)
                    if len(h):
                        digest = xxhash.xxh3_128_digest(h.tobytes())
                        row = (len(h), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), *sketch(h))
                    else:
                        row = (0, None, None, None, None)
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=["k", "n", "h1", "h2", "registers", "filled"])

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, n long, h1 long, h2 long, registers binary, filled binary")


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """``id, hashes`` of the wanted classes (id, k, h1, h2), each from a document that has that very set."""

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                want = [a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                sets = [shingles.of(t) for t in raw_texts(part.column(3))]
                same = [i for i, h in enumerate(sets) if xxhash.xxh3_128_digest(h.tobytes()) == want[i]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same, pa.int32())), pa.array([sets[i].astype(np.int64) for i in same], pa.list_(pa.int64()))], names=["id", "hashes"])

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t")).join(wanted, "k")
    return rows.select("id", "h1", "h2", "t").mapInArrow(run, "id long, hashes array<long>").dropDuplicates(["id"])


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs (a, b) whose estimate is six standard errors below the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            registers = [np.frombuffer(b"".join(c[x].to_pylist()), "<u2").reshape(-1, REGISTERS) for x in ("ra", "rb")]
            filled = [np.unpackbits(np.frombuffer(b"".join(c[x].to_pylist()), np.uint8).reshape(-1, REGISTERS // 8), axis=1).astype(bool) for x in ("fa", "fb")]
            na, nb = c["na"].to_numpy().astype(float), c["nb"].to_numpy().astype(float)
            found, buckets = estimate(*registers, *filled, na, nb)
            t = percent / 100
            keep = (found >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(buckets, 1))) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([c[x].filter(pa.array(keep)) for x in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    x = classes.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("filled").alias("fa"), F.col("n").alias("na"))
    y = classes.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("filled").alias("fb"), F.col("n").alias("nb"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long, na long, nb long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(x, "a").join(y, "b").withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


_GROUP = ["band", "kind", "i", "j"]


def _across(placed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, tile: int = 400_000, rows: int = 2048) -> DataFrame:
    """Links (a, b) between components that share a band bucket, enough of them to join what is linked.

    In a bucket that still holds several components every class outside its largest one is compared with
    the bucket's classes of other components, tile by tile (at most about ``rows`` classes and ``tile`` shingles on a side).
    Sketches alone are dealt first; classes that are likely to have a partner in a tile come again with
    their sets. Only links leave a task, never pairs, and buckets of the same classes are compared once.
    """
    parts = partitions(placed.sparkSession)
    marks = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")]
    mixed = placed.groupBy("band").agg(*marks).where("lo != hi").groupBy("members", "x", "y").agg(F.min("band").alias("band")).select("band")
    loose = written(placed.join(mixed, "band").join(classes.select("id", "n"), "id"), "loose")
    each = loose.groupBy("band", "component").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    largest = F.max(F.struct("many", "component", "n"))
    stats = each.groupBy("band").agg(largest.alias("main"), F.sum("many").alias("many"), F.sum("n").alias("n"))
    tiles = lambda n, many: F.greatest(F.ceil(n / tile), F.ceil(many / rows), F.lit(1)).cast("int")
    stats = stats.select(
        "band",
        F.col("main.component").alias("main"),
        tiles(F.col("n") - F.col("main.n"), F.col("many") - F.col("main.many")).alias("minors"),
        tiles(F.col("main.n"), F.col("main.many")).alias("mains"),
    )
    j = loose.join(stats, "band").withColumn("minor", F.col("component") != F.col("main"))
    t = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))).cast("int")
    j = j.withColumn("t", t)
    t = F.col("t")

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    among = F.transform(upto(F.col("minors")), lambda x: F.struct(F.lit(0).alias("kind"), F.least(t, x).alias("i"), F.greatest(t, x).alias("j")))
    to_main = F.transform(upto(F.col("mains")), lambda x: F.struct(F.lit(1).alias("kind"), t.alias("i"), x.alias("j")))
    from_main = F.transform(upto(F.col("minors")), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("i"), t.alias("j")))
    dealt = j.select("band", "id", "component", "minor", "t", F.explode(F.when(F.col("minor"), F.concat(among, to_main)).otherwise(from_main)).alias("g"))
    columns = [*_GROUP, "id", "component", "minor", "t"]

    def sorted_tiles(df):
        return df.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP)

    def likely(batches):
        for key, held in grouped(batches, 4):
            if (near := np.flatnonzero(_likely_rows(key, held, percent))).size:
                yield from held.select(columns).take(near).combine_chunks().to_batches()

    sketched = dealt.select("band", "g.*", "id", "component", "minor", "t").join(classes.select("id", "n", "registers", "filled"), "id")
    schema = "band long, kind int, i int, j int, id long, component long, minor boolean, t int"
    near = written(sorted_tiles(sketched.select(*columns, "n", "registers", "filled")).mapInArrow(likely, schema), "likely")

    def exact(batches):
        out: list = []
        for key, held in grouped(batches, 4):
            out += _links(key, held, percent)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    links = written(sorted_tiles(near.join(sets, "id").select(*columns, "hashes")).mapInArrow(exact, "a long, b long"), "more-links")
    discard(loose, near)
    return links


def _sides(key: tuple, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a tile pair's two sides."""
    _, kind, i, j = key
    minor, t = held.column("minor").to_numpy(), held.column("t").to_numpy()
    return np.flatnonzero(minor & (t == i)), np.flatnonzero(~minor) if kind else np.flatnonzero(minor & (t == j))


def _likely_rows(key: tuple, held: pa.Table, percent: int, block: int = 256) -> np.ndarray:
    """Which rows of a tile pair have a partner of another component that the estimate does not rule out."""
    left, right = _sides(key, held)
    out = np.zeros(held.num_rows, bool)
    if not len(left) or not len(right):
        return out
    registers = np.frombuffer(b"".join(held.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
    filled = np.unpackbits(np.frombuffer(b"".join(held.column("filled").to_pylist()), np.uint8).reshape(-1, REGISTERS // 8), axis=1).astype(bool)
    n, component = held.column("n").to_numpy().astype(float), held.column("component").to_numpy()
    octave, t = np.arange(58), percent / 100
    share = (1 - 2.0 ** -(octave + 1)) ** (n / REGISTERS)[:, None] - (1 - 2.0**-octave) ** (n / REGISTERS)[:, None]
    ours, theirs = np.where(filled, registers, 0xFFFF), np.ascontiguousarray(np.where(filled, registers, 0xFFFE)[right].T)  # no register is that large
    full, size = filled.astype(np.float32), filled.sum(1)
    for at in range(0, len(left), block):
        a = left[at : at + block]
        equal = np.zeros((len(a), len(right)), np.uint8)
        for r in range(REGISTERS):
            equal += ours[a, r][:, None] == theirs[r]
        both = full[a] @ full[right].T
        either = size[a][:, None] + size[right] - both
        chance = share[a] @ share[right].T / (1 << MANTISSA) * both
        near = (equal - chance) / np.maximum(either - chance, 1e-9) >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(either, 1))
        near &= component[a][:, None] != component[right]
        near &= 100 * np.minimum(n[a][:, None], n[right]) >= percent * np.maximum(n[a][:, None], n[right])
        out[a] |= near.any(1)
        out[right] |= near.any(0)
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, from the rows that hold each element."""
    width = len(right)
    flat = np.concatenate([*left, *right])
    of = np.repeat(np.arange(len(left) + width), [len(x) for x in [*left, *right]])
    order = np.lexsort((of, flat))
    flat, of = flat[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(first, len(flat)))
    mine = np.add.reduceat((of < len(left)).astype(np.int64), first)
    out = np.zeros(len(left) * width, np.int64)
    sizes = np.unique(np.stack([mine, count - mine])[:, (mine > 0) & (mine < count)], axis=1)
    for x, y in sizes.T.tolist():
        here = first[(mine == x) & (count == x + y)]
        step = max(1, 1_000_000 // (x * y))
        for at in range(0, len(here), step):
            f = here[at : at + step, None]
            pairs = (of[f + np.arange(x)] * width)[:, :, None] + (of[f + x + np.arange(y)] - len(left))[:, None, :]
            if pairs.size * 8 > out.size:
                out += np.bincount(pairs.ravel(), minlength=out.size)
            else:
                np.add.at(out, pairs.ravel(), 1)
    return out.reshape(len(left), width)


def _links(key: tuple, held: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the two sides of a tile pair, on full sets: enough of them to join what they join."""
    left, right = _sides(key, held)
    if not len(left) or not len(right):
        return []
    lists = held.column("hashes").chunk(0)
    flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    n = np.diff(edges)
    ids, component = held.column("id").to_numpy(), held.column("component").to_numpy()
    root = np.unique(component, return_inverse=True)[1]
    common = _common([sets[k] for k in left], [sets[k] for k in right])
    linked = 100 * common >= percent * (n[left][:, None] + n[right] - common)
    out = []
    for a, row in zip(left.tolist(), linked, strict=True):
        for b in right[row & (root[right] != root[a])].tolist():
            if root[a] != root[b]:
                out.append((int(ids[a]), int(ids[b])))
                root[root == root[b]] = root[a]
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word
    shingles (a shorter text is one shingle; without words the set is empty and links with nothing).
    component_id is the smallest key reachable over links, kept marks it. Rows that repeat a key with
    equal text are kept, each with the same result, and those with another text link by that text; rows of a null key take part in no link
    (component_id null, kept true); an empty table gives no rows; other columns are ignored.
    """
    signatures = written(_signatures(docs, key, text, width), "signatures")
    named = signatures.where("n > 0 and k is not null")
    # ids are numbers of their own, as a key may have several texts
    classes = written(named.groupBy("h1", "h2").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("filled").alias("filled")).withColumn("id", F.monotonically_increasing_id()), "classes")
    size = 2 * BAND
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + i * size, size)) for i in range(REGISTERS // BAND)])
    banded = classes.select("id", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("band", "first")
    members = written(banded.join(shared, "band").select("band", "id", "first"), "members")
    sets = written(_sets(docs, key, text, width, members.select("id").distinct().join(classes.select("id", "k", "h1", "h2"), "id")), "sets")
    stars = members.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    groups = components(_verified(_likely(stars, classes, percent), sets, percent))
    placed = members.join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    more = _across(placed, classes, sets, percent)
    # stars of what is joined already, and the links between them; without those, nothing changes
    final = groups if more.isEmpty() else components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(sets, members, more)
    least = final.join(classes.select("id", "k"), "id").groupBy("component").agg(F.min("k").alias("label"))
    of_class = classes.select("h1", "h2", "id", "k").join(final.join(least, "component"), "id", "left").select("h1", "h2", F.coalesce("label", "k").alias("component"))
    found = signatures.select("k", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    out = written(found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(True)).alias("kept")), "near-duplicates")
    discard(signatures, classes, groups, final)
    return out
