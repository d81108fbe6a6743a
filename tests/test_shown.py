"""Codes and text of fonts through page contents, forms and resources, on files made in code."""

import zlib

import pytest

from pdf_files import build, ref, simple
from paperloom.functions.glyphs import encodings, glyphs
from paperloom.plans import shown
from paperloom.session import cut
from paperloom.sources import pdf

FONT = {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica"}


def forms():
    """Two streams that only joined set a font; a form with its own F1, one without resources, and one that calls itself."""
    o = simple()
    o[3] = o[3] | {"Contents": ref(12), "Resources": ref(9)}
    o[12] = [ref(4), ref(13)]
    o[4] = ({"Filter": "/FlateDecode"}, zlib.compress(b"BT /F1 12 Tf"))
    o[13] = ({}, b"(A) Tj /X Do /Y Do /Inl 1 Tf [(z)] TJ /F0 1 Tf <0041FFFF00> Tj ET")
    o[9] = {"Font": ref(10), "XObject": {"X": ref(20), "Y": ref(21)}}
    o[10] = {"F1": ref(5), "F0": ref(6), "Inl": FONT | {"BaseFont": "/Inlined"}}
    o[5] = FONT | {"Encoding": {"BaseEncoding": "/MacRomanEncoding", "Differences": [65, "/Aacute", "/uni20AC", "/nothing", "/x1", 200, "/nothing"]}}
    o[6] = {"Type": "/Font", "Subtype": "/Type0", "BaseFont": "/Wide", "Encoding": "/Identity-H", "DescendantFonts": [ref(8)], "ToUnicode": ref(11)}
    o[8] = {"Type": "/Font", "Subtype": "/CIDFontType2", "CIDToGIDMap": "/Identity"}
    o[11] = ({}, b"1 beginbfchar <0041> <00660069> endbfchar")
    o[20] = ({"Subtype": "/Form", "Resources": {"Font": {"F1": ref(7)}, "XObject": {"X": ref(20)}}}, b"/F1 1 Tf (q\x80) Tj /X Do")
    o[7] = FONT | {"BaseFont": "/Other", "ToUnicode": ref(14)}
    o[14] = ({}, b"1 beginbfchar <71> <0051> endbfchar")
    o[21] = ({"Subtype": "/Form"}, b"/F1 1 Tf (BCD\xc8\x8a) Tj")
    o[22] = ({"Subtype": "/Form"}, b"/F1 1 Tf (unused) Tj")
    return o


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(1, bytearray(build(forms()))), (2, bytearray(build(simple())))]
    return pdf.tables_of(cut(spark.createDataFrame(rows, "file_id long, bytes binary").mapInArrow(pdf._parsed, pdf.PARSED)))


def test_text_of_fonts(tables):
    got = {(r.file_id, r.font, r.base_font, r.kind, r.code): r.text for r in shown.font_text(tables).collect()}
    own = {65: "Á", 66: "€", 67: "C", 68: "D", 0xC8: None, 0x8A: "ä"}
    want = {(1, "5", "Helvetica", "simple", c): s for c, s in own.items()}
    want |= {(1, "7", "Other", "simple", 0x71): "Q", (1, "7", "Other", "simple", 0x80): "€", (1, "inline:Inl", "Inlined", "simple", 0x7A): "z"}
    want |= {(1, "6", "Wide", "type0", 0x41): "fi", (1, "6", "Wide", "type0", 0xFFFF): None}
    assert got == want


def test_identity(tables):
    assert [(r.file_id, r.obj_num) for r in shown.identity_h(tables).collect()] == [(1, 6)]


def test_glyph_dimensions():
    known = glyphs()
    assert (known["A"], known["seven"], known["Scaron"], known["lambda"], known["Omega"], known["ogonek"]) == ("A", "7", "Š", "λ", "Ω", "˛")
    codes = {(e, c): s for e, c, s in encodings()}
    assert codes["WinAnsiEncoding", 0x80] == "€" and codes["MacRomanEncoding", 0xDB] == "¤" and ("WinAnsiEncoding", 0x81) not in codes and len(codes) == 95 * 2 + 123 + 128


def test_text_of_fonts_by_shuffle_joins(tables, monkeypatch):
    rows = lambda: sorted(map(str, shown.font_text(tables).collect()))
    small, joined = rows(), []
    monkeypatch.setattr(shown, "join_small", lambda big, few, on, how: joined.append(on) or big.join(few.hint("shuffle_merge"), on, how))
    assert rows() == small and len(joined) == 2
