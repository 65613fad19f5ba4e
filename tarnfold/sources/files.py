"""File contents: decoding, parsing to located pieces, and one extraction operator over binary files.

Parsers yield (text, locator) pieces; a collector bounds them. ``extract`` runs the parser that a file's
suffix asks for in ``mapInPandas``-style batches, one file in memory at a time.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.sources import pdf

# Suffixes and names that are read as text.
TEXT_SUFFIXES = (
    ".txt .md .markdown .log .py .pyi .js .mjs .cjs .ts .jsx .tsx .java .go .rs .c .cpp .cc .cxx .h .hpp .cs .sh .bash .zsh .ps1 "
    ".psm1 .sql .json .jsonl .yaml .yml .toml .ini .xml .conf .config .css .scss .sass .less .r .rb .php .swift .kt .kts .scala "
    ".vue .svelte .lua .pl .dart .ex .exs .erl .hrl .clj .cljs .fs .fsx .vb .bat .cmd .properties .env .rst .tex .gitignore "
    ".dockerignore .editorconfig"
).split()
TEXT_NAMES = frozenset("dockerfile makefile gemfile rakefile license readme".split())
MOST_FILE, MOST_CHARS, MOST_PIECE, MOST_PIECES = 32 << 20, 2_000_000, 1200, 20_000
MOST_ENTRIES, MOST_UNPACKED, MOST_XML = 20_000, 128 << 20, 64 << 20
#: As ``most_chars`` and ``most_bytes``: no bound, and none on pieces.
WHOLE = 1 << 62
# The characters below the blank that text may hold.
PLAIN_CONTROLS = "\t\n\f\r"


class Refused(Exception):
    """A file that cannot be read: ``status`` says how."""

    def __init__(self, status: str, reason: str):
        super().__init__(reason)
        self.status = status


class Remark(Exception):
    """The file was read; something about it is worth saying."""


class Full(Exception):
    """The character or piece budget is used up."""


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: a byte-order mark, UTF-16 by its zero bytes, strict UTF-8, else GB18030."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    head = data[:4096]
    if len(head) >= 4 and b"\0" in head:
        even, odd = head[::2].count(0) / len(head[::2]), head[1::2].count(0) / len(head[1::2])
        if max(even, odd) > 0.3 and min(even, odd) < 0.05:
            name = "utf-16-le" if odd > even else "utf-16-be"
            return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace"), "gb18030"


def is_binary(text: str) -> bool:
    """A NUL, or more than a tenth of control characters."""
    if "\0" in text:
        return True
    odd = sum(ord(c) < 32 and c not in PLAIN_CONTROLS for c in text)
    return bool(text) and odd > len(text) / 10


class Collector:
    """Takes located text, cuts it to pieces, and stops at the budget."""

    def __init__(self, most_chars: int = MOST_CHARS):
        self.pieces: list[tuple[str, dict]] = []
        self.left, self.most = most_chars, MOST_PIECES if most_chars < WHOLE else WHOLE

    def add(self, text: str, locator: dict) -> None:
        for at in range(0, len(text), MOST_PIECE):
            if len(self.pieces) >= self.most or self.left <= 0:
                raise Full
            piece = text[at : at + min(MOST_PIECE, self.left)]
            self.left -= len(piece)
            self.pieces.append((piece, locator))
            if len(piece) < min(MOST_PIECE, len(text) - at):
                raise Full


def _text_lines(text: str) -> Iterator[tuple[str, dict]]:
    lines, start, size = [], 1, 0
    for number, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        if lines and size + len(line) + 1 > MOST_PIECE:
            yield "\n".join(lines), {"line_start": start, "line_end": number - 1}
            lines, start, size = [], number, 0
        lines.append(line)
        size += len(line) + 1
    if any(x.strip() for x in lines):
        yield "\n".join(lines), {"line_start": start, "line_end": start + len(lines) - 1}


def parse_text(data: bytes) -> Iterator[tuple[str, dict]]:
    text, _ = decode(data)
    if is_binary(text):
        raise Refused("error", "binary content")
    yield from _text_lines(text)


class _Visible(HTMLParser):
    HIDDEN = frozenset({"script", "style", "template", "noscript"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.found.append((self.getpos()[0], data))


def visible_text(html: str) -> list[tuple[int, str]]:
    """(line, text) of what a page shows; scripts, styles, templates and noscript are dropped."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return [(line, re.sub(r"\s+", " ", text).strip()) for line, text in parser.found]


def parse_html(data: bytes) -> Iterator[tuple[str, dict]]:
    text, _ = decode(data)
    for line, piece in visible_text(text):
        yield piece, {"line_start": line, "line_end": line}


def parse_delimited(data: bytes, delimiter: str) -> Iterator[tuple[str, dict]]:
    text, _ = decode(data)
    try:
        for number, record in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True), 1):
            if any(cell.strip() for cell in record):
                yield "\t".join(record), {"record": number, "columns": len(record)}
    except csv.Error as e:
        raise Refused("error", f"not valid delimited text: {e}") from None


class Package:
    """A zip archive of XML parts, opened with limits on entries, size, encryption and declarations."""

    def __init__(self, data: bytes):
        if data[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
            raise Refused("encrypted", "protected or old office file")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise Refused("error", "damaged archive") from None
        entries = self.zip.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_UNPACKED:
            raise Refused("budget", "archive too large")
        if len({e.filename for e in entries}) != len(entries):
            raise Refused("error", "repeated archive entries")
        if any(e.flag_bits & 1 for e in entries):
            raise Refused("encrypted", "encrypted archive")
        self.names = {e.filename for e in entries}

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MOST_XML:
            raise Refused("budget", "document part too large")
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise Refused("error", "document type declarations are not read")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            raise Refused("error", "damaged document part") from None

    def elements(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements of a part that have this tag, one at a time as the part is unpacked; what was given is forgotten."""
        if name not in self.names:
            return
        parser, open_, tail = ElementTree.XMLPullParser(["start", "end"]), [], b""
        try:
            with self.zip.open(name) as part:
                while chunk := part.read(1 << 16):
                    seen = tail + chunk
                    if b"<!DOCTYPE" in seen or b"<!ENTITY" in seen:
                        raise Refused("error", "document type declarations are not read")
                    tail = chunk[-8:]
                    parser.feed(chunk)
                    for event, e in parser.read_events():
                        if event == "start":
                            open_.append(e)
                            continue
                        open_.pop()
                        if _tag(e) == tag:
                            yield e
                        if open_ and tag not in map(_tag, open_):  # nothing that is still to come needs it
                            open_[-1].remove(e)
                parser.close()
        except (ElementTree.ParseError, zipfile.BadZipFile):
            raise Refused("error", "damaged document part") from None


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _words(e: ElementTree.Element) -> str:
    """Text runs below an element; tabs and breaks as white space."""
    out = []
    for x in e.iter():
        kind = _tag(x)
        if kind == "t":
            out.append(x.text or "")
        elif kind in ("tab",):
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(data: bytes) -> Iterator[tuple[str, dict]]:
    root = Package(data).xml("word/document.xml")
    if root is None:
        raise Refused("error", "no document part")
    body = next((e for e in root if _tag(e) == "body"), root)
    paragraph = table = 0
    for block in body:
        if _tag(block) == "p":
            paragraph += 1
            if (text := _words(block)).strip():
                yield text, {"paragraph": paragraph}
        elif _tag(block) == "tbl":
            table += 1
            for number, row in enumerate((r for r in block if _tag(r) == "tr"), 1):
                cells = ["\n".join(filter(None, (_words(p) for p in c.iter() if _tag(p) == "p"))) for c in row if _tag(c) == "tc"]
                if any(c.strip() for c in cells):
                    yield "\t".join(cells), {"table": table, "row": number}


def _links(package: Package, name: str) -> dict[str, str]:
    folder, _, base = name.rpartition("/")
    root = package.xml(f"{folder}/_rels/{base}.rels")
    out = {}
    for r in root if root is not None else ():
        parts: list[str] = []
        target = r.get("Target", "")
        for p in (target[1:] if target.startswith("/") else f"{folder}/{target}").split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        out[r.get("Id", "")] = "/".join(parts)
    return out


def _relation(e: ElementTree.Element) -> str:
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and not re.search(r"general", bare, re.I)


def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shift_formula(formula: str, rows: int, columns: int) -> str:
    """A shared formula as it reads some rows and columns away; absolute parts and quoted text stay."""

    def moved(m: re.Match) -> str:
        if m[0].startswith(('"', "'")):
            return m[0]
        fixed_c, letters, fixed_r, number = m[1], m[2], m[3], m[4]
        column = letters if fixed_c else _column_letters(max(1, _column_number(letters) + columns))
        row = number if fixed_r else str(max(1, int(number) + rows))
        return f"{fixed_c}{column}{fixed_r}{row}"

    return re.sub(r"\"[^\"]*\"|'[^']*'|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)(\d{1,7})(?![A-Za-z0-9_(])", moved, formula)


def parse_xlsx(data: bytes) -> Iterator[tuple[str, dict]]:
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise Refused("error", "no workbook part")
    epoch = datetime(1904, 1, 1) if any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book) else datetime(1899, 12, 30)
    strings = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in package.elements("xl/sharedStrings.xml", "si")]
    styles, dated = package.xml("xl/styles.xml"), []
    if styles is not None:
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _tag(f) == "numFmt"}
        cells = next((e for e in styles if _tag(e) == "cellXfs"), ())
        dated = [(n := int(x.get("numFmtId", 0))) in DATE_FORMATS or n in custom and _is_date(custom[n]) for x in cells]
    links = _links(package, "xl/workbook.xml")
    for sheet in (e for e in book.iter() if _tag(e) == "sheet"):
        shared: dict[str, tuple[str, int, int]] = {}
        for row in package.elements(links.get(_relation(sheet), ""), "row"):
            shown, first, last = [], None, None
            for cell in (c for c in row if _tag(c) == "c"):
                place = cell.get("r", "")
                value = _cell(cell, strings, dated, epoch)
                formula = next((f for f in cell if _tag(f) == "f"), None)
                if formula is not None:
                    text = formula.text or ""
                    m = re.fullmatch(r"([A-Z]+)(\d+)", place)
                    if formula.get("t") == "shared" and m:
                        column, number = _column_number(m[1]), int(m[2])
                        if text:
                            shared[formula.get("si", "")] = (text, number, column)
                        elif formula.get("si", "") in shared:
                            text, r0, c0 = shared[formula.get("si", "")]
                            text = shift_formula(text, number - r0, column - c0)
                    value = f"={text} -> {value}" if value else f"={text}"
                if value:
                    shown.append(f"{place}: {value}")
                    first, last = first or place, place
            if shown:
                yield "\t".join(shown), {"sheet": sheet.get("name", ""), "cells": f"{first}:{last}"}


def _cell(cell, strings, dated, epoch) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
    raw = next((v.text or "" for v in cell if _tag(v) == "v"), "")
    if kind == "s":
        return strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    style = int(cell.get("s", 0) or 0)
    if kind == "n" and raw and style < len(dated) and dated[style]:
        try:
            moment = epoch + timedelta(days=float(raw))
        except (ValueError, OverflowError):
            return raw
        moment = (moment + timedelta(microseconds=500_000)).replace(microsecond=0)
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(sep=" ")
    return raw


def parse_pptx(data: bytes) -> Iterator[tuple[str, dict]]:
    package = Package(data)
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise Refused("error", "no presentation part")
    links = _links(package, "ppt/presentation.xml")
    for number, entry in enumerate((e for e in deck.iter() if _tag(e) == "sldId"), 1):
        name = links.get(_relation(entry), "")
        root = package.xml(name)
        if root is None:
            continue
        for p in (e for e in root.iter() if _tag(e) == "p"):
            if (text := _words(p)).strip():
                yield text, {"slide": number}
        for target in _links(package, name).values():
            notes = package.xml(target) if "/notesSlides/" in target else None
            for shape in (s for s in notes.iter() if _tag(s) == "sp") if notes is not None else ():
                kinds = {p.get("type") for p in shape.iter() if _tag(p) == "ph"}
                if kinds & {"sldNum", "dt", "ftr", "hdr", "sldImg"}:
                    continue
                for p in (e for e in shape.iter() if _tag(e) == "p"):
                    if (text := _words(p)).strip():
                        yield text, {"slide": number, "notes": True}


def parse_pdf(data: bytes) -> Iterator[tuple[str, dict]]:
    try:
        document = pdf.Document(data)
        empty = 0
        for number, page in enumerate(document.pages(), 1):
            if text := document.text(page):
                yield text, {"page": number}
            else:
                empty += 1
    except pdf.Encrypted as e:
        raise Refused("encrypted", str(e)) from None
    except pdf.Damaged as e:
        raise Refused("error", str(e)) from None
    if empty:
        raise Remark(f"pages without text: {empty} (nothing is recognised in images)")


def parser_of(name: str):
    name = name.rpartition("/")[2].lower()
    suffix = "." + name.rpartition(".")[2] if "." in name else ""
    special = {".html": parse_html, ".htm": parse_html, ".csv": lambda d: parse_delimited(d, ","), ".tsv": lambda d: parse_delimited(d, "\t"), ".docx": parse_docx, ".xlsx": parse_xlsx, ".pptx": parse_pptx, ".pdf": parse_pdf}
    if suffix in special:
        return special[suffix]
    return parse_text if suffix in TEXT_SUFFIXES or name in TEXT_SUFFIXES or name in TEXT_NAMES else None


def extract_bytes(name: str, data: bytes, most_chars: int = MOST_CHARS, most_bytes: int = MOST_FILE) -> dict:
    """``status, reason, truncated, chunks`` of one file."""
    if len(data) > most_bytes:
        return {"status": "budget", "reason": "file too large", "truncated": False, "chunks": []}
    parser = parser_of(name)
    if parser is None:
        return {"status": "unsupported", "reason": "no reader for this kind of file", "truncated": False, "chunks": []}
    bag, status, reason, cut = Collector(most_chars), "ready", None, False
    try:
        for text, locator in parser(data):
            bag.add(text, locator)
    except Full:
        status, reason, cut = "partial", "text budget reached", True
    except Remark as e:
        reason = str(e)
    except Refused as e:
        return {"status": e.status, "reason": str(e), "truncated": False, "chunks": []}
    except Exception as e:  # a damaged file must not stop the job
        return {"status": "error", "reason": type(e).__name__, "truncated": False, "chunks": []}
    return {"status": status, "reason": reason, "truncated": cut, "chunks": [{"text": t, "locator": json.dumps(x, sort_keys=True)} for t, x in bag.pieces]}


CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("locator", T.StringType())])
EXTRACTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("truncated", T.BooleanType()), T.StructField("chunks", T.ArrayType(CHUNK))])


def read_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files below a folder, on any store of Spark's."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def extract(files: DataFrame, most_chars: int = MOST_CHARS, most_bytes: int = MOST_FILE, path: str = "path", content: str = "content") -> DataFrame:
    """``path, status, reason, truncated, chunks`` of every file row. Larger files are not read; with ``WHOLE`` as bounds all are, to their end."""
    data = F.when(F.octet_length(content) <= most_bytes, F.col(content))
    rows = files.select(F.col(path).alias("path"), data.alias("content"), F.col(content).isNull().alias("lost"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("locator", pa.string())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                paths = part.column(0).to_pylist()
                out = []
                for name, body, lost in zip(paths, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if body is None:
                        out.append({"status": "error" if lost else "budget", "reason": "no content" if lost else "file too large", "truncated": False, "chunks": []})
                    else:
                        out.append(extract_bytes(name or "", body, most_chars, most_bytes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([o[k] for o in out], t) for k, t in (("status", pa.string()), ("reason", pa.string()), ("truncated", pa.bool_()), ("chunks", kind)))],
                    names=["path", "status", "reason", "truncated", "chunks"],
                )

    return rows.mapInArrow(run, EXTRACTED)
