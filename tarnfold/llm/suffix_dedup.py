"""Exact removal of repeated passages with difference-cover suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The suffixes that
matter are the starts of such strings. They are dealt so that equal strings meet and unequal ones part:

1. Every ``length``-byte string owns an anchor, the byte run of ``gram`` bytes in it with the smallest
   hash (the rightmost of equal ones; runs of a period up to 16 come last, so that filler does not make an
   anchor a byte). Equal strings own equal anchors at equal places. Neighbouring starts share an anchor
   and make a unit: its context is the text from the first start to the last end.
2. Units whose anchor occurs once cannot repeat and are left out; of what remains one context of each kind
   is dealt, by anchor, with the number of its occurrences.
3. Each deal is suffix-sorted by the difference-cover algorithm: the triples at two of three positions
   are sorted and named, the names are sorted by recursion (until names are unique or span ``length``
   bytes), the other suffixes are sorted by one character and the rank behind it, and both are merged.
   Then adjacent suffixes' prefixes are compared over ``length`` bytes: where they agree, or where the
   context occurs more than once, the string repeats.

An anchor with more than ``most`` different contexts (a very common passage in different surroundings) is
dealt again by a longer anchor, and so on: ``width`` neighbouring starts share their common core of
``length - width + 1`` bytes, for falling widths. At width 1 the core is the string itself, so a deal holds
one string and its number. Every width gives the same answer; ``most`` bounds what a task holds.

Scale: the corpus-wide state is a count of anchors (one in about ``length`` / 2.4 bytes). A text is
shuffled twice (once for its contexts, once for its result), equal texts once a task. ``suffix_array.py``
has the corpus-wide sort of the same algorithm, and the README what it costs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, partitions, written

_PIECE = 1 << 18
_LOW = np.uint64((1 << 24) - 1)
_LAST = np.uint64(1 << 63)
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SENT = 8_000_000  # bytes of an Arrow batch on its way out


def _run_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, by doubling."""

    def joined(a, b):
        x = a * _STEP
        x += b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        return x

    now, size = _BYTE[text], 1
    while size < gram:
        more = min(size, gram - size)
        now = joined(now[: len(now) - more], now[more:])
        size += more
    return now


def _short_periods(text: np.ndarray, gram: int) -> np.ndarray:
    """Which runs of ``gram`` bytes have a period of at most 16 (or half of ``gram``)."""
    top = min(16, gram // 2)
    out = np.zeros(len(text) - gram + 1, bool)
    for period in range(top // 2 + 1, top + 1):  # every smaller period divides one of these
        now, size = text[period:] == text[:-period], 1
        while size < gram - period:
            more = min(size, gram - period - size)
            now = now[: len(now) - more] & now[more:]
            size += more
        out |= now
    return out


def pieces_of(texts: list[bytes], length: int):
    """Lists of (row, place in the text, bytes) with ``_PIECE`` bytes or a little more; long texts in pieces that overlap."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for base in range(0, max(0, len(t) - length + 1), _PIECE):
            piece = t[base : base + _PIECE + length - 1]
            held.append((i, base, piece))
            size += len(piece)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def units(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of these pieces: number of the piece, first and last start, place of the anchor, its hash."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    hashes = _run_hashes(text, gram)
    keys = (hashes >> np.uint64(1)) & ~_LOW
    keys |= _LOW - np.arange(len(hashes), dtype=np.uint64)
    keys[_short_periods(text, gram)] |= _LAST
    span, size = length - gram + 1, 1
    while size < span:
        more = min(size, span - size)
        keys = np.minimum(keys[: len(keys) - more], keys[more:])
        size += more
    place = (_LOW - (keys & _LOW)).astype(np.int64)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    starts = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    at = place[starts]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(owner) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
    of = owner[first]
    return of, starts[first] - begin[of], starts[last] - begin[of], at[first] - begin[of], hashes[at[first]]


def suffix_order(s: np.ndarray, top: int, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` (values 1..top) in order, right over ``depth`` characters at least.

    Suffixes that agree over ``depth`` characters stand together, in any order.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a start behind the end if n mod 3 is 1
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    base = top + 1
    triples = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    order = np.argsort(triples)
    ranked = triples[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
    most = int(names.max())
    if most < len(sample) and depth > 3:
        order = suffix_order(names, most, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    zero = zero[np.argsort(padded[zero] * wide + rank[zero + 1])]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    # sorted once more, as suffixes that agree over the depth may stand in any order
    below = np.searchsorted(np.sort(padded[ones] * wide + rank[ones + 1]), padded[zero] * wide + rank[zero + 1])
    below += np.searchsorted(np.sort((padded[twos] * base + padded[twos + 1]) * wide + rank[twos + 2]), np.maximum.accumulate((padded[zero] * base + padded[zero + 1]) * wide + rank[zero + 2]))
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + below] = zero
    out[out < 0] = sorted_sample
    return out


def repeated_starts(contexts: list[bytes], many: list[int], length: int) -> list[np.ndarray]:
    """For each context which of its ``length``-byte strings occurs elsewhere, by adjacent prefixes."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin, sizes, strict=False)])
    owner = np.repeat(np.arange(len(contexts)), sizes - length + 1)
    symbols = text.astype(np.int64) + 2
    symbols[begin[1:] - 1] = 1
    found = np.repeat(np.array(many) > 1, sizes - length + 1)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    order = suffix_order(symbols, 257, length)
    order = order[is_start[order]]
    same = np.zeros(len(order), bool)
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(order) - 1, 16384):
        a, b = order[at : at + 16384], order[at + 1 : at + 16385]
        a = a[: len(b)]
        same[at : at + len(a)] = (strings[a] == strings[b]).all(1)
    slot = np.empty(len(text), np.int64)
    slot[starts] = np.arange(len(starts))
    hit = slot[order]
    found[hit[:-1][same[:-1]]] = True
    found[hit[1:][same[:-1]]] = True
    edges = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [found[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    step = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return step[::2].tolist(), (step[1::2] - 1).tolist()


def _sliced(columns: list[list], kinds: dict[str, pa.DataType], sizes: list[int]):
    """Arrow batches of about ``_SENT`` bytes."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= _SENT or k == len(sizes) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c[first : k + 1], t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
            first, total = k + 1, 0


_INT, _BIG = pa.int32(), pa.int64()


def _units_of(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``h1, h2, p, l, o, g, c`` for texts (h1, h2, t): starts p to p + l, the anchor o bytes behind p, hashes of anchor and context.

    A unit that occurs again near by comes once; rows of a null ``g`` are the runs of such starts, which repeat.
    """

    def run(batches):
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = list({k: i for i, k in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))}.values())  # equal texts once
            texts = batch.column(2)
            for at in range(0, len(new), 64):
                rows_of = new[at : at + 64]
                for held in pieces_of([texts[i].as_buffer().to_pybytes() for i in rows_of], length):
                    pieces = [p for _, _, p in held]
                    of, first, last, anchor, g = units(pieces, length, gram)
                    c = np.fromiter((xxhash.xxh3_64_intdigest(pieces[k][a:b]) for k, a, b in zip(of.tolist(), first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(of))
                    row = np.array([rows_of[i] for i, _, _ in held])[of]
                    first_of_text = np.array([b for _, b, _ in held])[of]
                    _, one, number, many = np.unique(c * np.uint64(3) + g * _STEP + row.astype(np.uint64) * _BYTE[7], return_index=True, return_inverse=True, return_counts=True)
                    p, l, o, nulls = first_of_text + first, last - first, anchor - first, np.zeros(len(of), bool)
                    pick = slice(None)
                    if len(one) < len(of):  # units that repeat in these pieces: their starts as runs, each unit once
                        again = np.flatnonzero(many[number] > 1)
                        q = p[again] + l[again]
                        edge = np.flatnonzero(np.concatenate([[True], (p[again][1:] > q[:-1] + 1) | (row[again][1:] != row[again][:-1])]))
                        run_p, run_q = p[again][edge], q[np.append(edge[1:] - 1, len(again) - 1)]
                        pick = np.sort(one)
                        p, l, o = (np.concatenate(x) for x in ((p[pick], run_p), (l[pick], run_q - run_p), (o[pick], np.zeros(len(edge), np.int64))))
                        nulls = np.concatenate([np.zeros(len(pick), bool), np.ones(len(edge), bool)])
                        row, g, c = (np.concatenate([x[pick], x[again][edge]]) for x in (row, g, c))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1[row]), pa.array(h2[row]), pa.array(p.astype(np.int32)), pa.array(l.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(g.astype(np.int64), mask=nulls), pa.array(c.astype(np.int64))],
                        names=["h1", "h2", "p", "l", "o", "g", "c"],
                    )

    return rows.select("h1", "h2", F.col("t").cast("binary").alias("t")).mapInArrow(run, "h1 long, h2 long, p int, l int, o int, g long, c long")


def _sorted_deals(contexts: DataFrame, length: int) -> DataFrame:
    """``g, c, a, b``: first and last starts of the repeated strings of contexts (g, n, context), by anchor."""
    kinds = {"g": _BIG, "c": _BIG, "a": pa.list_(_INT), "b": pa.list_(_INT)}

    def run(batches):
        held: list[tuple] = []
        size, current = 0, None

        def close():
            out: list[list] = [[], [], [], []]
            found = repeated_starts([h[3] for h in held], [h[2] for h in held], length)
            for (g, c, _, _), f in zip(held, found, strict=True):
                if f.any():
                    for column, v in zip(out, (g, c, *_runs(f)), strict=True):
                        column.append(v)
            yield from _sliced(out, kinds, [200] * len(out[0]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current and size > 1_000_000:
                    yield from close()
                    held, size = [], 0
                current = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield from close()

    dealt = contexts.select("g", "c", "n", "context").repartition(partitions(contexts.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "g long, c long, a array<int>, b array<int>")


def _cores(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts in runs of ``width`` starts (on a grid that begins at the anchor), each with its common core as anchor."""
    kinds = {"g0": _BIG, "c0": _BIG, "s": _INT, "g": _BIG, "c": _BIG, "n": _BIG, "o": _INT, "context": pa.binary()}

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            sizes = []
            for g, c, n, o, context in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                first, last = 0, len(context) - length
                while first <= last:  # starts that have as many steps of ``width`` to the anchor
                    end = min(last, first + (o - first) % width)
                    part = context[first : end + length]
                    ahead = (o - first) // width
                    # the grid's core, from its last start to its first end, is in every string of the run
                    core_from = first + (o - first) % width
                    core_to = core_from - width + 1 + length
                    seed = (g * 31 + ahead) & (1 << 64) - 1
                    digest = xxhash.xxh3_64_intdigest(context[core_from:core_to], seed=seed)
                    row = (g, c, first, digest - (1 << 63), xxhash.xxh3_64_intdigest(part, seed=digest) - (1 << 63), n, o - first, part if width > 1 else None)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    sizes.append(len(part) + 60)
                    first = end + 1
            yield from _sliced(out, kinds, sizes)

    return contexts.select("g", "c", "n", "o", "context").mapInArrow(run, "g0 long, c0 long, s int, g long, c long, n long, o int, context binary")


def _decided(contexts: DataFrame, length: int, most: int, widths: tuple[int, ...], made: list) -> DataFrame:
    """``g, c, a, b`` of contexts (g, c, n, o, context) whose anchor has several: sorted deals, crowded ones by longer anchors."""
    if not widths:
        return _sorted_deals(contexts, length)
    crowded = written(contexts.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("g"), "crowded")
    made.append(crowded)
    if crowded.isEmpty():
        return _sorted_deals(contexts, length)
    plain = _sorted_deals(contexts.join(crowded, "g", "left_anti"), length)
    parts = written(_cores(contexts.join(crowded, "g", "left_semi"), length, widths[0]), "cores", "zstd")
    made.append(parts)
    several = parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.first("o").alias("o"), F.first("context").alias("context"))
    if widths[0] == 1:  # the anchor is the string: what occurs more than once repeats
        found = several.where("n > 1").select("g", "c", F.array(F.lit(0)).alias("a"), F.array(F.lit(0)).alias("b"))
    else:
        several = written(several, "core-contexts", "zstd")
        made.append(several)
        kinds = several.groupBy("g").agg(F.count("*").alias("kinds"))
        shared = several.join(kinds.where("kinds > 1").select("g"), "g", "left_semi")
        alone = several.where("n > 1").join(kinds.where("kinds = 1").select("g"), "g", "left_semi")
        whole = alone.select("g", "c", F.array(F.lit(0)).alias("a"), F.array(F.octet_length("context") - length).alias("b"))
        found = _decided(shared, length, most, widths[1:], made).unionByName(whole)
    shift = lambda x: F.transform(x, lambda v: v + F.col("s"))
    back = parts.select("g0", "c0", "s", "g", "c").join(found, ["g", "c"]).select(F.col("g0").alias("g"), F.col("c0").alias("c"), shift(F.col("a")).alias("a"), shift(F.col("b")).alias("b"))
    return plain.unionByName(back)


def repeated_spans(rows: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, list]:
    """``h1, h2, runs``: for texts (h1, h2, t) the first and last starts (a, b) of repeated strings; and tables to discard."""
    rows = rows.where(F.octet_length("t") >= length)
    seen = written(_units_of(rows, length, gram), "units", "zstd")
    again = seen.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    places = written(seen.join(again, "g").select(*seen.columns), "places", "zstd")
    inside = seen.where("g is null").select("h1", "h2", F.array(F.struct(F.col("p").alias("a"), (F.col("p") + F.col("l")).alias("b"))).alias("runs"))
    kinds = written(places.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "p", "l", "o")).alias("at")), "kinds", "zstd")
    several = kinds.groupBy("g").agg(F.count("*").alias("kinds"))
    # one occurrence of each context whose anchor has several; where it has one, its number decides
    wanted = kinds.join(several.where("kinds > 1").select("g"), "g").select("at.*", "g", "c", "n")
    lists = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("p", "l", "o", "g", "c", "n")).alias("want"))
    kept = {"g": _BIG, "c": _BIG, "n": _BIG, "o": _INT, "context": pa.binary()}

    def slices(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kept]
            sizes = []
            for t, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = memoryview(t.as_buffer())
                for w in want:
                    context = bytes(text[w["p"] : w["p"] + w["l"] + length])
                    for column, v in zip(out, (w["g"], w["c"], w["n"], w["o"], context), strict=True):
                        column.append(v)
                    sizes.append(len(context) + 60)
            yield from _sliced(out, kept, sizes)

    texts = rows.select("h1", "h2", F.col("t").cast("binary").alias("t")).dropDuplicates(["h1", "h2"])
    contexts = texts.join(lists, ["h1", "h2"]).select("t", "want").mapInArrow(slices, "g long, c long, n long, o int, context binary")
    contexts = written(contexts, "contexts", "zstd")
    made = [contexts]
    decided = _decided(contexts, length, most, tuple(w for w in (16, 1) if w < length), made)
    alone = kinds.where("n > 1").join(several.where("kinds = 1").select("g"), "g", "left_semi").select("g", "c", F.array(F.lit(0)).alias("a"), F.array("at.l").alias("b"))
    hits = places.select("h1", "h2", "p", "g", "c").join(decided.unionByName(alone), ["g", "c"])
    shifted = F.transform(F.arrays_zip("a", "b"), lambda x: F.struct((F.col("p") + x["a"]).alias("a"), (F.col("p") + x["b"]).alias("b")))
    copies = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.octet_length("t")).alias("size")).where("n > 1")
    whole = copies.select("h1", "h2", F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - length).alias("b"))).alias("runs"))
    runs = hits.select("h1", "h2", shifted.alias("runs")).unionByName(inside).unionByName(whole)
    return runs.groupBy("h1", "h2").agg(F.flatten(F.collect_set("runs")).alias("runs")), [seen, places, kinds, *made]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 32, most: int = 4096, keep: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    With ``keep`` all columns of ``docs`` come first (those of the result's names replaced), and
    ``kept`` holds the bytes left, ``kept_text`` the whole characters left. A null or
    short text loses nothing. Rows of equal text count as occurrences of each other, whatever their keys, and
    have the same result; null and repeated keys are values like any other; an empty table gives no rows. A text may be of any
    length that a column holds, periodic ones included: it is worked on in pieces, and what repeats inside a piece is kept once.
    """
    names = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"}
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    h1, h2 = F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("second"), t).alias("h2")
    rows = docs.select(h1, h2, t.alias("t"))
    spans, made = repeated_spans(rows, length, gram, most)
    kinds = {"h1": _BIG, "h2": _BIG, "removed": _INT, "spans": _INT, "sha": pa.string()} | ({"left": pa.binary(), "left_text": pa.string()} if keep else {})

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            sizes = []
            for h1, h2, t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                t = t.as_buffer().to_pybytes()
                a, b = runs.values.field("a").to_numpy(), runs.values.field("b").to_numpy() + length
                order = np.argsort(a)
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                a, b = a[new], b[np.append(new[1:] - 1, len(b) - 1)]
                left = [t[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)], strict=True)]
                whole = b"".join(left)
                row = [h1, h2, int((b - a).sum()), len(a), hashlib.sha256(whole).hexdigest()]
                if keep:
                    row += [whole, "".join(x.decode("utf-8", "ignore") for x in left)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                sizes.append(2 * len(whole) * keep + 100)
            yield from _sliced(out, kinds, sizes)

    texts = rows.where(F.octet_length("t") >= length).select("h1", "h2", F.col("t").cast("binary").alias("t")).dropDuplicates(["h1", "h2"])
    schema = "h1 long, h2 long, removed int, spans int, sha string" + ", left binary, left_text string" * keep
    cut = written(texts.join(spans, ["h1", "h2"]).mapInArrow(run, schema), "cut", "zstd")
    discard(*made)
    fields = [f for f in docs.columns if (f not in names if keep else f == key)]
    own = docs.select(h1, h2, t.alias("t"), F.struct(*[docs[f] for f in fields]).alias("row")) if keep else docs.select(h1, h2, F.octet_length(t).alias("size"), F.sha2(t.cast("binary"), 256).alias("own"), docs[key].cast("long").alias(key))
    joined = own.join(cut, ["h1", "h2"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in ((F.octet_length("t") if keep else F.col("size"), "n_bytes"), (F.col("removed"), "n_removed"), (F.col("spans"), "n_spans"))]
    if not keep:
        return joined.select(key, *counts, F.coalesce("sha", "own").alias("kept_sha256"))
    sha = F.coalesce("sha", F.sha2(F.col("t").cast("binary"), 256)).alias("kept_sha256")
    return joined.select("row.*", *counts, sha, F.coalesce("left", F.col("t").cast("binary")).alias("kept"), F.coalesce("left_text", "t").alias("kept_text"))
