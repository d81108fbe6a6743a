"""PDF files made in code: the inputs of the document tests."""

import zlib

PAGE = {"Type": "/Page", "MediaBox": [0, 0, 612, 792]}


def ref(n):
    return {"r": [n, 0]}


def build(objects, root=1, info=None):
    """Objects by number: a value, or (dictionary, stream bytes)."""
    import json

    from paperloom.sinks.pdf import serialized

    rows = [(n, 0, json.dumps(v[0] if isinstance(v, tuple) else v), v[1] if isinstance(v, tuple) else None) for n, v in objects.items()]
    return serialized(rows, {"Root": ref(root)} | ({"Info": ref(info)} if info else {}))


def simple(content=b"BT /F1 12 Tf (Hello) Tj ET", **catalog):
    return {1: {"Type": "/Catalog", "Pages": ref(2)} | catalog, 2: {"Type": "/Pages", "Kids": [ref(3)], "Count": 1}, 3: PAGE | {"Parent": ref(2), "Contents": ref(4), "Resources": {}}, 4: ({}, content)}


def fonts():
    """Helvetica embedded, with a prefix, and a font of its own that stays; 15 000 bytes of font file each."""
    o = simple()
    o[3] = o[3] | {"Resources": {"Font": {"F1": ref(5), "F2": ref(8)}}}
    o |= {5: {"Type": "/Font", "Subtype": "/TrueType", "BaseFont": "/ABCDEF+Helvetica", "FontDescriptor": ref(6), "ToUnicode": ref(11)}, 6: {"Type": "/FontDescriptor", "FontName": "/ABCDEF+Helvetica", "FontFile2": ref(7)}}
    o |= {7: ({}, bytes(i % 256 for i in range(15_000))), 8: {"Type": "/Font", "Subtype": "/TrueType", "BaseFont": "/MyCustomFont-Regular", "FontDescriptor": ref(9)}, 9: {"Type": "/FontDescriptor", "FontName": "/MyCustomFont-Regular", "FontFile2": ref(10)}}
    o |= {10: ({}, bytes(i * 7 % 256 for i in range(15_000))), 11: ({}, b"1 beginbfchar <41> <0041> endbfchar")}
    return o


def bloated():
    """Poor compression, three equal streams of which two are used, private data, metadata, and orphans."""
    o = simple(b"0 0 m\n" * 400)
    o[1] |= {"Metadata": ref(20)}
    o[3] |= {"PieceInfo": {"x": 1}, "Thumb": ref(25), "Resources": {"XObject": {"A": ref(21), "B": ref(22)}}}
    o |= {n: ({"Type": "/XObject", "Subtype": "/Form"}, bytes([42]) * 500) for n in (21, 22, 23)}
    o |= {24: ({"Filter": "/FlateDecode"}, zlib.compress(b"0123456789" * 300, 0)), 25: ({"Subtype": "/Image", "Width": 10, "Height": 10}, b"t" * 100), 26: {"orphan": True}}
    o[20] = ({"Type": "/Metadata", "Subtype": "/XML"}, b'<x:xmpmeta><dc:language><rdf:Bag><rdf:li>fr</rdf:li></rdf:Bag></dc:language><dc:title><rdf:Alt><rdf:li xml:lang="x-default"> T </rdf:li></rdf:Alt></dc:title></x:xmpmeta>')
    return o


def archival():
    o = fonts()
    o[1] |= {"Metadata": ref(20)}
    o[20] = ({"Type": "/Metadata", "Subtype": "/XML"}, b'<pdfaid:part>1</pdfaid:part><pdfaid:conformance>b</pdfaid:conformance>')
    return o


def tagged():
    o = simple(Lang={"s": "en-US".encode().hex()}, MarkInfo={"Marked": True}, StructTreeRoot=ref(30))
    o |= {30: {"Type": "/StructTreeRoot", "K": [ref(31)]}, 31: {"Type": "/StructElem", "S": "/Document", "K": [ref(32), ref(33), ref(34)], "P": ref(30)}, 32: {"Type": "/StructElem", "S": "/P", "K": 0, "P": ref(31)}}
    o |= {33: {"Type": "/StructElem", "S": "/Figure", "Alt": {"s": "61"}, "P": ref(31)}, 34: {"Type": "/StructElem", "S": "/Figure", "P": ref(31), "K": [ref(31)]}}
    return o


def images():
    o = simple()
    o[3] = PAGE | {"MediaBox": [0, 0, 100, 100], "Parent": ref(2), "Contents": ref(4), "Resources": {"XObject": {"A": ref(5), "B": ref(6), "C": ref(7), "D": ref(8)}}}
    base = {"Type": "/XObject", "Subtype": "/Image", "ColorSpace": "/DeviceRGB", "BitsPerComponent": 8}
    o[5] = (base | {"Width": 400, "Height": 400, "Filter": "/FlateDecode"}, zlib.compress(bytes(480_000)))
    o[6] = (base | {"Width": 10, "Height": 10}, bytes(300))
    o[7] = (base | {"Width": 200, "Height": 200, "SMask": ref(6)}, bytes(120_000))
    o[8] = (base | {"Width": 100, "Height": 100, "Filter": "/DCTDecode"}, b"\xff\xd8" + bytes(5000))
    return o
