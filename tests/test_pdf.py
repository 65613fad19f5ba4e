"""PDF text from files made by hand: tables and streams of references, object streams, maps, damage."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.sources import files, pdf


def flate(data, extra=b""):
    body = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s>>\nstream\n%s\nendstream" % (len(body), extra, body)


def plain(data, extra=b""):
    return b"<< /Length %d %s>>\nstream\r\n%s\nendstream" % (len(data), extra, data)


def built(objects, trailer=b"", table=True):
    """A file of numbered objects with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start, size = len(out), max(objects) + 1
    if table:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        out += b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(1, size))
        out += b"trailer\n<< /Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start)
    return bytes(out)


def pages(contents, fonts=b"/F1 5 0 R", more=None, make=flate):
    """Objects of a document whose pages have these content streams; object 5 is the font."""
    first = 10
    kids = b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(contents)))
    out = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << %s >> /XObject << /Fm 7 0 R >> >> >>" % (len(contents), kids, fonts),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    }
    for k, c in enumerate(contents):
        out[first + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * k + 1)
        out[first + 2 * k + 1] = make(c)
    return out | (more or {})


def texts(data):
    out = files.extract_bytes("a.PDF", data)
    assert out["status"] == "ready", out
    return [c["text"] for c in out["chunks"]], out["reason"]


@pytest.mark.parametrize("make", [flate, plain])
def test_pages_and_lines(make):
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)\\041) Tj 0 -14 Td [(Sp) -50 (lit) -300 (words)] TJ T* (caf\\351 \\200) Tj ET"
    two = b"BT /F1 9 Tf 1 0 0 1 72 700 Tm <41 42 4> Tj 1 0 0 1 100 700 Tm (same line) Tj 1 0 0 1 72 600 Tm (next) Tj (a) ' ET"
    out = files.extract_bytes("x.pdf", built(pages([one, two], make=make)))
    assert [c["text"] for c in out["chunks"]] == ["Hello (world)!\nSplit words\ncafé €", "AB@ same line\nnext\na"] and out["status"] == "ready"
    assert [c["locator"] for c in out["chunks"]] == ['{"page": 1}', '{"page": 2}']


def test_unicode_maps_and_forms():
    cmap = b"""1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <6570636E> <0004> <D83DDE00> endbfchar
    2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0066> <00660069>] endbfrange"""
    more = {5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 6: flate(cmap), 7: flate(b"BT /F1 1 Tf <00100011> Tj ET", b"/Type /XObject /Subtype /Form ")}
    got, _ = texts(built(pages([b"BT /F1 1 Tf <000300040012> Tj <002000210099> Tj ET /Fm Do"], more=more)))
    assert got == ["数据😀Cffi\nAB"]
    named = {5: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /one /uni00E9 /space /fi /Q] >> >>"}
    assert texts(built(pages([b"BT /F1 1 Tf (ABCDE) Tj ET"], more=named)))[0] == ["1é ﬁQ"]


def test_pages_without_text_are_told():
    got, reason = texts(built(pages([b"BT /F1 1 Tf (one) Tj ET", b"0 0 m 5 5 l S", b"q BI /W 1 ID \x00(no) Tj EI Q"])))
    assert got == ["one"] and "2" in reason
    got, reason = texts(built({**pages([b""]), 11: b"null"}))
    assert got == [] and "1" in reason


def test_encrypted_and_limits():
    out = files.extract_bytes("a.pdf", built(pages([b"BT (x) Tj ET"]), b"/Encrypt 9 0 R "))
    assert out["status"] == "encrypted"
    long = built(pages([b"BT /F1 1 Tf (%s) Tj ET" % (b"x" * 3000)] * 3))
    cut = files.extract_bytes("a.pdf", long, most_chars=4000)
    assert cut["status"] == "partial" and sum(len(c["text"]) for c in cut["chunks"]) == 4000
    assert files.extract_bytes("a.pdf", built(pages([b"x"], make=lambda d: flate(d).replace(b"FlateDecode", b"JBIG2Decode"))))["status"] == "error"


def test_object_and_reference_streams():
    objects = pages([b"BT /F1 12 Tf (inside) Tj ET"])
    packed = [n for n in objects if n != 11]
    bodies, heads, at = [], [], 0
    for n in packed:
        heads.append(b"%d %d" % (n, at))
        bodies.append(objects[n] + b"\n")
        at += len(bodies[-1])
    head = b" ".join(heads) + b"\n"
    held = {11: objects[11], 20: flate(head + b"".join(bodies), b"/Type /ObjStm /N %d /First %d " % (len(packed), len(head)))}
    data = bytearray(built(held, table=False))
    start = len(data)
    rows = []
    for n in range(22):
        if n in packed:
            rows.append(bytes([2]) + (20).to_bytes(3, "big") + bytes([packed.index(n)]))
        elif n in held or n == 21:
            rows.append(bytes([1]) + (start if n == 21 else data.index(b"%d 0 obj" % n)).to_bytes(3, "big") + b"\0")
        else:
            rows.append(bytes(5))
    up, above = bytearray(), bytes(5)
    for r in rows:  # differences to the row above
        up += b"\2" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
        above = r
    data += b"21 0 obj\n" + flate(bytes(up), b"/Type /XRef /Size 22 /W [1 3 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 5 >> ") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    assert texts(bytes(data))[0] == ["inside"]
    broken = bytes(data).replace(b"startxref\n%d" % start, b"startxref\n7")
    assert texts(broken)[0] == ["inside"]  # by the objects' headers


def test_damaged_references_and_updates():
    data = built(pages([b"BT /F1 1 Tf (old) Tj ET"], make=plain))
    assert texts(data.replace(b"xref\n0", b"xxxx\n0"))[0] == ["old"]
    new = b"11 0 obj\n" + plain(b"BT /F1 1 Tf (new) Tj ET") + b"\nendobj\n"
    start, before = len(data) + len(new), data.rindex(b"xref\n0")
    more = data + new + b"xref\n11 1\n%010d 00000 n \ntrailer\n<< /Size 12 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (len(data), before, start)
    assert texts(more)[0] == ["new"]
    loop = {**pages([b""]), 2: b"<< /Type /Pages /Kids [2 0 R 2 0 R] >>"}
    assert files.extract_bytes("a.pdf", built(loop))["status"] in ("ready", "error")
    wrong = built(pages([b"BT /F1 1 Tf (length) Tj ET"], make=lambda d: b"<< /Length 3 >>\nstream\n%s\nendstream" % d))
    assert texts(wrong)[0] == ["length"]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_damage_is_one_file_only(data):
    good = bytearray(built(pages([b"BT /F1 1 Tf (text) Tj ET"])))
    for _ in range(data.draw(st.integers(1, 12))):
        good[data.draw(st.integers(8, len(good) - 1))] = data.draw(st.integers(0, 255))
    assert files.extract_bytes("a.pdf", bytes(good[: data.draw(st.integers(9, len(good)))]))["status"] in ("ready", "error", "encrypted")


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30))
def test_strings_round_trip(raw):
    literal = b"(" + b"".join(b"\\%03o" % b for b in raw) + b")"
    assert pdf.Lexer(literal).value() == raw and pdf.Lexer(b"<" + raw.hex().encode() + b">").value() == raw
