from __future__ import annotations

import zlib

import numpy as np
import pytest

from pixelloom.sources import images
from pixelloom.sources.codecs import ImageError, pdf


def document(*contents, box="0 0 300 200", extra=b"", flate=False):
    out, kids = [b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"], []
    for k, c in enumerate(contents):
        page, body = 10 + 2 * k, 11 + 2 * k
        kids.append(f"{page} 0 R")
        raw = zlib.compress(c) if flate else c
        out.append(f"{page} 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [{box}] /Contents {body} 0 R /Resources << /Font << /F1 5 0 R >> >> >>\nendobj\n".encode())
        out.append(f"{body} 0 obj\n<< /Length {len(raw)} {'/Filter /FlateDecode' if flate else ''} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n")
    out.append(f"2 0 obj\n<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>\nendobj\n".encode())
    return b"".join(out) + extra + b"trailer\n<< /Root 1 0 R >>\nstartxref\n9\n%%EOF\n"


def test_text_and_pages():
    data = document(b"BT /F1 12 Tf 100 100 Td (Hello \\(a\\) \\101) Tj T* [(W) -120 (orld)] TJ ET", b"BT (two) Tj ET", flate=True)
    assert pdf.page_count(data) == 2
    assert pdf.text(data, 0) == "Hello (a) A\nWorld" and pdf.text(data, 1) == "two"
    with pytest.raises(ImageError, match="page index out of range"):
        pdf.decode(data, 2)


def test_code_maps():
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <0203> <0205> <0061> endbfrange"
    extra = b"5 0 obj\n<< /Type /Font /ToUnicode 6 0 R >>\nendobj\n6 0 obj\n<< /Length 200 >>\nstream\n" + cmap + b"\nendstream\nendobj\n"
    assert pdf.text(document(b"BT /F1 9 Tf <01020302050420> Tj ET", extra=extra)) == "Aac\x04 ".replace("\x04", "")


def test_fill_and_stroke():
    got = pdf.decode(document(b"1 0 0 rg 30 30 60 60 re f 0 0 1 RG 3 w 150 20 m 150 180 l S"), trim=False).rgba
    assert got.shape == (267, 400, 4)
    red = (got[..., 0] == 255) & (got[..., 1] == 0)
    assert red.sum() == 80 * 80 and got[200, 60, 0] == 255
    blue = (got[..., 2] == 255) & (got[..., 0] == 0)
    assert set(np.flatnonzero(blue[100])) == {198, 199, 200, 201}
    hole = pdf.decode(document(b"0 g 0 0 90 90 re 30 30 30 30 re f"), trim=False).rgba
    assert hole[200, 60, 0] == 255 and hole[250, 20, 0] == 0
    moved = pdf.decode(document(b"q 2 0 0 2 30 0 cm 0 0 15 15 re f Q 0 0 3 3 re f"), trim=False).rgba
    assert moved[260, 45, 0] == 0 and moved[260, 20, 0] == 255 and moved[265, 1, 0] == 0


def test_trim():
    data = document(b"0 g 120 80 60 40 re f")
    full, cut = pdf.decode(data, trim=False).rgba, pdf.decode(data).rgba
    assert cut.shape[0] < full.shape[0] and cut.shape[1] < full.shape[1]
    assert (cut[..., 0] == 0).sum() == (full[..., 0] == 0).sum()
    blank = pdf.decode(document(b""))
    assert (blank.width, blank.height) == (400, 267)


def test_glyphs_are_a_parameter():
    data = document(b"BT /F1 24 Tf 30 100 Td (i) Tj ET")
    dot = pdf.decode(data, trim=False, glyph=lambda c: b"\1" + b"\0" * 7).rgba
    assert (dot[..., 0] == 0).sum() == 2 * 4  # one bit, scaled


@pytest.mark.parametrize("data, message", [
    (b"%PDX", "invalid PDF header"), (b"%PDF-1.4", "missing PDF EOF marker"), (b"%PDF-1.4 %%EOF", "missing startxref"), (b"%PDF-1.4 startxref 0 %%EOF", "missing PDF root"),
])
def test_errors(data, message):
    with pytest.raises(ImageError, match=message):
        pdf.decode(data)


def test_tables(spark):
    rows = [("a", bytearray(document(b"BT (x) Tj ET", b"0 g"))), ("b", bytearray(b"%PDF-1.4"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert [(r.op, r.args) for r in images.pdf_operators(df).orderBy("seq").collect()] == [("BT", []), ("Tj", ["x"]), ("ET", [])]
    got = {(r.path, r.page): (r.text, r.error) for r in images.pdf_text(df).collect()}
    assert got == {("a", 0): ("x", None), ("a", 1): ("", None), ("b", None): (None, "missing PDF EOF marker")}
    pages = images.decode_images(df, page="all").collect()
    assert [(r.path, r.page, r.error is None) for r in sorted(pages, key=lambda r: (r.path, r.page))] == [("a", 0, True), ("a", 1, True), ("b", 0, False)]
