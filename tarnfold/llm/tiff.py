"""TIFF media columns: a reader for one row per page, and a lossless writer.

The reader walks the image directories of either byte order, decodes strips or tiles that are plain,
PackBits, LZW or deflate, undoes horizontal and floating-point differencing and joins planes to interleaved
samples: unsigned of 1, 2, 4, 8, 16, 32 or 64 bits, signed of 8 and more, floating point of 16, 32 or 64.
The writer makes strips or tiles with the same compressions.

Scale: one pass without a shuffle; a task holds one page at a time, of at most ``largest`` bytes of samples.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import raw_texts

# Tags and compression numbers of the TIFF 6.0 specification, and Adobe's deflate.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 278, 279, 284, 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END = 256, 257


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray  # height x width x samples; samples of less than 8 bits as bytes
    sample_format: int = 1  # unsigned, signed, floating point: 1, 2, 3


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 2 or at + run == n and run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """At least ``size`` bytes, if the data hold them; what follows is left alone."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, made, hold, have, width, last = [], 0, 0, 0, 9, None
    for byte in data:
        hold = hold << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = hold >> have
        hold &= (1 << have) - 1
        if code == END:
            break
        if code == CLEAR:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            if code > 255:
                raise ValueError("damaged LZW data")
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("damaged LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        made += len(entry)
        if made >= size:
            break
        last = entry
        # codes widen one entry early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, table, word = [(CLEAR, 9)], {bytes((i,)): i for i in range(256)}, b""
    following, width = 258, 9
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = following
        following += 1
        width = max(width, 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12)
        if following == 4094:
            codes.append((CLEAR, width))
            table = {bytes((k,)): k for k in range(256)}
            following, width = 258, 9
        word = data[i : i + 1]
    if word:
        codes.append((table[word], width))
        following += 1
        width = max(width, 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12)
    codes.append((END, width))
    out, hold, have = bytearray(), 0, 0
    for code, bits in codes:
        hold = hold << bits | code
        have += bits
        while have >= 8:
            have -= 8
            out.append(hold >> have & 255)
        hold &= (1 << have) - 1
    if have:
        out.append(hold << 8 - have & 255)
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    stream = zlib.decompressobj()
    return stream.decompress(data, size)


def directories(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order and the tags of each directory, in the order of their links."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack_from(order + "H", data, 2)
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
    found, seen = [], set()
    while at:
        if at in seen or at >= len(data):
            raise ValueError("directory links do not end")
        seen.add(at)
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(count)
        tags = {}
        for i in range(n):
            here = at + i * entry
            tag, kind, many = struct.unpack_from(order + "HH" + word, data, here)
            if kind not in TYPES and kind not in (5, 10):
                continue
            form = order + (f"{many}{TYPES[kind]}" if kind in TYPES else f"{2 * many}{'I' if kind == 5 else 'i'}")
            value = here + 4 + struct.calcsize(word)
            if struct.calcsize(form) > struct.calcsize(word):
                (value,) = struct.unpack_from(order + word, data, value)
            tags[tag] = struct.unpack_from(form, data, value)
        found.append(tags)
        (at,) = struct.unpack_from(order + word, data, at + n * entry)
    return order, found


def _segment(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return _inflate(data, size)
    raise ValueError(f"compression {compression} is not supported")


def read_pages(data: bytes, largest: int = 1 << 28):
    """The pages of a file, one at a time; more than ``largest`` bytes of samples in all are refused."""
    order, found = directories(data)
    for k, tags in enumerate(found):
        page = _read_page(data, order, tags, k, largest)
        largest -= page.pixels.nbytes
        yield page


def _whole(tags: dict, tag: int, default: tuple | None = None, least: int = 0) -> tuple:
    """The values of a tag of whole numbers."""
    values = tags.get(tag, default)
    if not values or not all(isinstance(v, int) and v >= least for v in values):
        raise ValueError(f"tag {tag} is missing or out of range")
    return values


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _read_page(data: bytes, order: str, tags: dict, number: int, largest: int) -> Page:
    width, height = _whole(tags, WIDTH, least=1)[0], _whole(tags, LENGTH, least=1)[0]
    samples = _whole(tags, SAMPLES, (1,), 1)[0]
    each, forms = _whole(tags, BITS, (1,), 1), _whole(tags, SAMPLE_FORMAT, (1,))
    bits, form = each[0], 1 if forms[0] == 4 else forms[0]  # undefined samples are read as they are
    compression, predictor = _whole(tags, COMPRESSION, (NONE,))[0], _whole(tags, PREDICTOR, (1,))[0]
    if len(set(each)) > 1 or len(set(forms)) > 1 or bits not in {1: (1, 2, 4, 8, 16, 32, 64), 2: (8, 16, 32, 64), 3: (16, 32, 64)}.get(form, ()):
        raise ValueError(f"samples of {each} bits in format {forms} are not supported")
    if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or form == 3) or predictor == 3 and form != 3:
        raise ValueError(f"predictor {predictor} with {bits} bits in format {form} is not supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(max(1, bits // 8)))
    if height * width * samples * kind.itemsize > largest:
        raise ValueError(f"{width} x {height} x {samples} samples are more than {largest} bytes")
    separate = _whole(tags, PLANAR, (1,))[0] == 2 and samples > 1
    planes, depth = (samples, 1) if separate else (1, samples)
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, high = _whole(tags, TILE_WIDTH, least=1)[0], _whole(tags, TILE_LENGTH, least=1)[0]
        offsets, counts = _whole(tags, TILE_OFFSETS), _whole(tags, TILE_COUNTS)
    else:
        wide, high = width, min(_whole(tags, ROWS_PER_STRIP, (height,), 1)[0], height)
        offsets, counts = _whole(tags, STRIP_OFFSETS), _whole(tags, STRIP_COUNTS)
    if wide * high * depth * kind.itemsize > largest:
        raise ValueError("segments are too large")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise ValueError("segments do not cover the image")
    reverse = _whole(tags, FILL_ORDER, (1,))[0] == 2
    pixels = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down)
        row, column = divmod(rest, across)
        rows = high if tiled else min(high, height - row * high)
        line = -(-wide * depth * bits // 8)  # bytes of a row, which begins on a byte
        raw = data[at : at + n].translate(_REVERSED) if reverse else data[at : at + n]
        raw = _segment(raw, compression, rows * line)
        if len(raw) < rows * line:
            raise ValueError("segment too short")
        block = _samples(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), kind, bits, predictor, (rows, wide, depth)).astype(pixels.dtype)
        into = pixels[row * high : row * high + rows, column * wide : column * wide + wide]
        block = block[: into.shape[0], : into.shape[1]]
        if separate:
            into[:, :, plane] = block[:, :, 0]
        else:
            into[...] = block
    return Page(number, width, height, samples, bits, compression, pixels, form)


def _samples(lines: np.ndarray, kind: np.dtype, bits: int, predictor: int, shape: tuple) -> np.ndarray:
    """Samples of rows of bytes, with differences undone."""
    rows, wide, depth = shape
    if bits < 8:
        parts = [lines >> np.uint8(at) & np.uint8((1 << bits) - 1) for at in range(8 - bits, -1, -bits)]
        return np.stack(parts, axis=2).reshape(rows, -1)[:, : wide * depth].reshape(shape)
    if predictor == 3:  # differences of bytes; the bytes of a row's numbers stand by significance, highest first
        whole = np.cumsum(lines.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, wide * depth)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    block = np.ascontiguousarray(lines).view(kind).reshape(shape)
    return np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def write_pages(
    images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1
) -> bytes:
    """A TIFF file of these images (height x width x samples): whole numbers, or floating point (predictors 1 and 3)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        bits = 8 * image.dtype.itemsize
        wide, high = (tile[1], tile[0]) if tile else (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = image[y : y + high, x : x + wide]
                if tile and block.shape[:2] != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    moved = block.copy()
                    moved[:, 1:] -= block[:, :-1]
                    block = moved
                raw = block.astype(np.dtype(image.dtype).newbyteorder(order)).tobytes()
                if predictor == 3:
                    numbers = np.ascontiguousarray(block.astype(np.dtype(image.dtype).newbyteorder(">"))).view(np.uint8)
                    lines = numbers.reshape(len(block), -1, image.dtype.itemsize).transpose(0, 2, 1).reshape(len(block), -1, samples)
                    moved = lines.copy()
                    moved[:, 1:] -= lines[:, :-1]
                    raw = moved.tobytes()
                raw = {NONE: lambda d: d, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, level)}[compression](raw)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        if len(out) % 2:
            out.append(0)
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if image.dtype.kind != "u":
            tags.append((SAMPLE_FORMAT, 3, [{"i": 2, "f": 3}[image.dtype.kind]] * samples))
        tags += [(TILE_WIDTH, 4, [wide]), (TILE_LENGTH, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                place = struct.pack(order + "I", len(out))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                place = packed.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + place)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def features(pixels: np.ndarray) -> str:
    """Size, range, mean, spread and entropy of the samples, as text."""
    flat = pixels.reshape(-1)
    small = flat.dtype.kind == "u" and flat.dtype.itemsize < 4
    rows, columns = pixels.shape[:2]
    if small:  # all from the counts, gathered a part at a time, as a page may be most of a task's memory
        counts = np.zeros(1 << 8 * flat.dtype.itemsize, np.int64)
        for at in range(0, flat.size, 1 << 20):
            counts += np.bincount(flat[at : at + (1 << 20)], minlength=len(counts))
        (values,) = np.nonzero(counts)
        share = counts[values] / max(1, flat.size)
        entropy, mean = float(-(share * np.log2(share)).sum()) + 0.0, float((share * values).sum())
        std = float(np.sqrt((share * (values - mean) ** 2).sum()))
        return f"{columns}x{rows} min={values.min()} max={values.max()} mean={mean:.4f} std={std:.4f} entropy={entropy:.4f}"
    counts = np.unique(flat, return_counts=True)[1]
    share = counts[counts > 0] / max(1, flat.size)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    wide = flat.astype(np.float64)
    with np.errstate(all="ignore"):
        return f"{columns}x{rows} min={flat.min()} max={flat.max()} mean={wide.mean():.4f} std={wide.std():.4f} entropy={entropy:.4f}"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64, compression: int = DEFLATE) -> DataFrame:
    """Each text as a one-page 8-bit TIFF: ``key, n_bytes, media``.

    The payload is the UTF-8 text (null: none) and zero bytes up to a positive multiple of ``width``,
    the image's width. Equal texts give equal files. Null keys and repeated rows stay, each a row; an empty table gives
    no rows; other columns are ignored. A text of any length is one page of strips.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = raw_texts(part.column(1))
                media = []
                for t in texts:
                    size = max(1, -(-len(t) // width)) * width
                    media.append(write_pages([np.frombuffer(t.ljust(size, b"\0"), np.uint8).reshape(-1, width, 1)], compression))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["k", "n_bytes", "media"])

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, n_bytes long, media binary").withColumnRenamed("k", key)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, sample_format int, compression int, pixels binary, feature string, error string"


def read_media(rows: DataFrame, media: str = "media", largest: int | Column = 1 << 28) -> DataFrame:
    """One row per page of each TIFF in the binary column ``media``, with the row's other columns.

    New columns (a clashing name of the input is replaced): page, width, height, samples, bits, sample_format,
    compression, pixels (interleaved, little-endian; a byte a sample of less than 8 bits), feature, error. A null file,
    one without pages and one that cannot be read give a row with page null and the reason in error, after the pages before the
    damage; pages of more than ``largest`` bytes of samples (a number, or a column where rows know their size) count as damage. Null keys and repeated rows stay; an empty table
    gives no rows.
    """
    from pyspark.sql import types as T

    made = T._parse_datatype_string(PAGE_SCHEMA)
    names = {f.name for f in made.fields}
    kept = [f for f in rows.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *made.fields])
    rows = rows.withColumn("__largest", (largest if isinstance(largest, Column) else F.lit(largest)).cast("long"))
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string(), pa.string()]

    def pages_of(data, most):
        try:
            if data is None:
                raise ValueError("no data")
            number = None
            for p in read_pages(data, most):
                number = p.number
                yield p.number, p.width, p.height, p.samples, p.bits, p.sample_format, p.compression, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), features(p.pixels), None
            if number is None:
                raise ValueError("no pages")
        except Exception as e:  # whatever a damaged file leads to
            yield (None,) * 9 + (str(e) or type(e).__name__,)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bounds = batch.column(batch.schema.get_field_index("__largest"))
            for i, data in enumerate(batch.column(batch.schema.get_field_index(media))):
                same = table.slice(i, 1)
                for page in pages_of(data.as_py(), bounds[i].as_py() or 0):
                    columns = [pa.array([v], t) for v, t in zip(page, kinds, strict=True)]
                    yield from pa.Table.from_arrays([*[same.column(f.name).combine_chunks() for f in kept], *columns], names=schema.names).to_batches()

    return rows.mapInArrow(_gathered(run), schema)


def _gathered(run, rows: int = 256, size: int = 16_000_000):
    """Joins the small batches of ``run`` so that the stream has fewer of them."""

    def out(batches):
        held, n, total = [], 0, 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            total += b.nbytes
            if n >= rows or total >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n, total = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def digests(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of stored one-page texts that were read back with ``read_media``, a row for each of its rows.

    Null keys and repeated rows stay; where the file could not be read the payload's columns are null; an empty table gives no rows.
    """
    return pages.select(
        key,
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
