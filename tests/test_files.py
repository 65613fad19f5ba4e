import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.operators.chunking import chunk_documents, cuts, split_pieces
from tarnfold.sources import files




def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("encoding,name", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("utf-16-le", "utf-16-le"), ("utf-16-be", "utf-16-be"), ("gb18030", "gb18030")])
def test_decoding(encoding, name):
    text = "plain ascii words 123\n" * 4 + ("中文内容" if encoding != "utf-16-le" and encoding != "utf-16-be" else "end")
    got, found = files.decode(text.encode(encoding))
    assert found == name and got == text


def test_lines_and_binary():
    out = files.extract_bytes("a.txt", b"one\r\ntwo\rthree\n")
    assert out["status"] == "ready" and out["chunks"][0]["text"] == "one\ntwo\nthree\n"
    assert files.extract_bytes("a.txt", b"ab\x01\x02\x03\x04")["status"] == "error"
    for c in range(1, 32):  # a tenth and more of any control character but tab, line feed, form feed and return
        assert (files.extract_bytes("a.txt", b"abcdef" + bytes([c]))["status"] == "error") == (chr(c) not in "\t\n\f\r")
        assert files.extract_bytes("a.txt", b"abcdefghij" + bytes([c]))["status"] == "ready"
    assert files.extract_bytes("a.xyz", b"ab")["status"] == "unsupported"
    assert files.extract_bytes("a.txt", b"abc", most_bytes=2)["status"] == "budget"
    assert files.extract_bytes("Makefile", b"all:")["status"] == "ready"
    assert files.extract_bytes("a.txt", b"")["chunks"] == []


def test_budget_gives_partial():
    out = files.extract_bytes("a.txt", b"x" * 5000, most_chars=1500)
    assert out["status"] == "partial" and out["truncated"] and sum(len(c["text"]) for c in out["chunks"]) == 1500


def test_whole_texts(spark):
    body = "line of text\n" * 400_000
    rows = spark.createDataFrame([("a.txt", bytearray(body.encode()))], "path string, content binary")
    cut = files.extract(rows).first()
    assert cut.status == "partial" and cut.truncated
    (out,) = files.extract(rows, files.WHOLE, files.WHOLE).select("status", F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.length(c["text"])).alias("n")).collect()
    assert out.status == "ready" and out.n >= len(body) - 5000


def test_html():
    out = files.extract_bytes("p.html", b"<p>A &amp; B</p><script>var x = '<p>'</script>\n<style>p{}</style><noscript>n</noscript><b>C</b>")
    assert [c["text"] for c in out["chunks"]] == ["A & B", "C"]
    assert json.loads(out["chunks"][1]["locator"])["line_start"] == 2


def test_delimited():
    out = files.extract_bytes("t.csv", b'a,"x\ny"\n\n1,2\n')
    assert [c["text"] for c in out["chunks"]] == ["a\tx\ny", "1\t2"]
    assert files.extract_bytes("t.csv", b'"open')["status"] == "error"
    assert [c["text"] for c in files.extract_bytes("t.tsv", b"a\tb")["chunks"]] == ["a\tb"]


W = 'xmlns:w="urn:w"'


def test_docx():
    doc = f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    out = files.extract_bytes("d.docx", zipped({"word/document.xml": doc}))
    assert [(c["text"], json.loads(c["locator"])) for c in out["chunks"]] == [("Hello\tthere", {"paragraph": 1}), ("a\tb", {"row": 1, "table": 1})]
    assert files.extract_bytes("d.docx", b"not a zip")["status"] == "error"
    assert files.extract_bytes("d.docx", bytes.fromhex("d0cf11e0a1b11ae1") + b"x")["status"] == "encrypted"
    assert files.extract_bytes("d.docx", zipped({"word/document.xml": "<!DOCTYPE x><a/>"}))["status"] == "error"
    assert files.extract_bytes("d.docx", zipped({"x": "y"}))["status"] == "error"


def test_xlsx():
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    shared = "<sst><si><t>word</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>"
    styles = '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/></cellXfs></styleSheet>'
    sheet = (
        '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" s="1"><v>45292</v></c><c r="E1" s="2"><v>45292.5</v></c><c r="F1" t="inlineStr"><is><t>in</t></is></c></row>'
        '<row r="2"><c r="A2"><f t="shared" si="0" ref="A2:A3">B2*$C$1+1</f><v>3</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/><v>4</v></c></row></sheetData></worksheet>'
    )
    out = files.extract_bytes("b.xlsx", zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": shared, "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet}))
    assert out["status"] == "ready"
    texts = [c["text"] for c in out["chunks"]]
    assert texts[0] == "A1: word\tB1: ab\tC1: TRUE\tD1: 2024-01-01\tE1: 2024-01-01 12:00:00\tF1: in"
    assert texts[1] == "A2: =B2*$C$1+1 -> 3" and texts[2] == "A3: =B3*$C$1+1 -> 4"
    assert json.loads(out["chunks"][0]["locator"]) == {"sheet": "S1", "cells": "A1:F1"}


def test_pptx():
    deck = '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>'
    rels = '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>'
    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    notes = '<p:notes xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:ph type="sldNum"/><a:p><a:r><a:t>7</a:t></a:r></a:p></p:sp><p:sp><p:ph type="body"/><a:p><a:r><a:t>say</a:t></a:r></a:p></p:sp></p:notes>'
    note_rels = '<Relationships><Relationship Id="x" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    parts = {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": slide.format("one"), "ppt/slides/slide2.xml": slide.format("two"), "ppt/slides/_rels/slide1.xml.rels": note_rels, "ppt/notesSlides/notesSlide1.xml": notes}
    out = files.extract_bytes("s.pptx", zipped(parts))
    assert [(c["text"], json.loads(c["locator"])) for c in out["chunks"]] == [("two", {"slide": 1}), ("one", {"slide": 2}), ("say", {"notes": True, "slide": 2})]


def test_pdf_damage():
    assert files.extract_bytes("a.pdf", b"%PDF-1.4")["status"] == "error" and files.extract_bytes("a.pdf", b"none")["status"] == "error"


def test_shared_formulas():
    assert files.shift_formula('SUM(A1:$B$2)+"A1"+LOG10(C3)', 2, 1) == 'SUM(B3:$B$2)+"A1"+LOG10(D5)'


def test_read_and_extract_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.md"].status == "ready" and rows["b.bin"].status == "unsupported"
    chunks = chunk_documents(files.extract(files.read_files(spark, str(tmp_path)))).collect()
    assert [c.text for c in chunks] == ["# T\n\n", "body"] or "".join(c.text for c in chunks) == "# T\n\nbody"


def test_headings_and_locators():
    text = "# One\nfirst.\n\n## Two\n" + "A sentence here. " * 40
    out = list(split_pieces([(text, {"line_start": 1, "line_end": 5})]))
    assert out[0][1]["heading"] == "One" and out[-1][1]["heading"] == "Two" and all(len(t) <= 350 for t, _ in out)
    assert out[0][1]["line_start"] == 1 and out[1][1]["line_start"] >= 3


def test_hard_cuts_overlap_at_words():
    text = "word " * 200
    spans = list(cuts(text, 100, 20))
    assert spans[0] == (0, 100) and all(b - a <= 100 for a, b in spans)
    assert spans[1][0] < 100


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#中。!", max_size=900), st.integers(32, 120))
def test_chunks_lose_nothing_and_map_back(text, most):
    pieces = [(text[i : i + 300], {"page": i // 600}) for i in range(0, len(text), 300)]
    covered: dict[int, set] = {i: set() for i in range(len(pieces))}
    for chunk, locator in split_pieces(pieces, most=most, overlap=10):
        assert 0 < len(chunk) <= most
        for s in locator["source_spans"]:
            assert pieces[s["source_chunk"]][0][s["char_start"] : s["char_end"]] == chunk[s["piece_start"] : s["piece_end"]]
            covered[s["source_chunk"]] |= set(range(s["char_start"], s["char_end"]))
    for i, (piece, _) in enumerate(pieces):
        assert all(k in covered[i] or not c.strip() for k, c in enumerate(piece))


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError):
        list(split_pieces([], most=10))


def test_a_large_sheet_is_streamed():
    """A sheet of over 100 MiB, of which the rows are never together in memory; a larger archive is refused."""
    import tracemalloc

    row = "<row r='%d'>" + "".join(f"<c r='{c}%d' t='inlineStr'><is><t>{'x' * 400}</t></is></c>" for c in "ABCDE") + "</row>"
    sheet = "<worksheet xmlns='m'><sheetData>" + "".join(row % ((i,) * 6) for i in range(48_000)) + "</sheetData></worksheet>"
    assert 100 << 20 < len(sheet) < 127 << 20
    book = "<workbook xmlns:r='r'><sheets><sheet name='S' r:id='a'/></sheets></workbook>"
    rels = "<Relationships><Relationship Id='a' Target='worksheets/sheet1.xml'/></Relationships>"
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet}
    data = zipped(parts)
    del sheet
    tracemalloc.start()
    n = sum(1 for _ in files.parse_xlsx(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 48_000 and peak < 40 << 20
    parts["xl/worksheets/sheet1.xml"] = " " * (129 << 20)
    assert files.extract_bytes("b.xlsx", zipped(parts))["status"] == "budget"
    parts["xl/worksheets/sheet1.xml"] = "<!DOCTYPE x [<!ENTITY a 'b'>]><worksheet><row/></worksheet>"
    assert files.extract_bytes("b.xlsx", zipped(parts))["status"] == "error"
    parts["xl/worksheets/sheet1.xml"] = "<worksheet><row r='1'><c r='A1'><v>1</v></c></row><row"
    assert files.extract_bytes("b.xlsx", zipped(parts))["status"] == "error"
