"""PDF source, inspection, passes and guards, on files made in code."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from pdf_files import archival, bloated, build, fonts, images, ref, simple, tagged
from paperloom.functions import codecs
from paperloom.functions.fonts import aliases, to_unicode
from paperloom.functions.text import batch_tier
from paperloom.functions.tokens import tokenise, tokens, used_codes
from paperloom.options import PRESETS, Options
from paperloom.plans import inspect, passes
from paperloom.session import cut, shared_dir
from paperloom.sources import pdf

FILES = {1: simple(), 2: fonts(), 3: bloated(), 4: archival(), 5: tagged(), 6: images()}


@pytest.fixture(scope="module")
def files(spark):
    shared_dir(spark)
    rows = [(k, bytearray(build(o))) for k, o in FILES.items()] + [(99, bytearray(b"not a pdf"))]
    return spark.createDataFrame(rows, "file_id long, bytes binary").repartition(4)


@pytest.fixture(scope="module")
def tables(files):
    t = pdf.tables_of(cut(files.mapInArrow(pdf._parsed, pdf.PARSED)))
    return t


@pytest.fixture(scope="module")
def optimised(files):
    data, stats = passes.run(files)
    counters = {}
    for r in stats.collect():
        counters.setdefault(r.file_id, {}).setdefault(r["pass"], {})[r.counter] = r.n
    return {r.file_id: (bytes(r.bytes), r.kept_original) for r in data.collect()}, counters


def test_parse(tables):
    found = {}
    for r in tables.objects.groupBy("file_id").count().collect():
        found[r.file_id] = r["count"]
    assert found == {k: len(o) for k, o in FILES.items()}
    assert [(r.file_id, "invalid" in r.error) for r in tables.errors.collect()] == [(99, True)]
    edges = {(r.src_num, tuple(r.key_path), r.dst_num) for r in tables.refs.where("file_id = 1").collect()}
    assert edges == {(1, ("Pages",), 2), (2, ("Kids", "0"), 3), (3, ("Parent",), 2), (3, ("Contents",), 4)}
    assert {(r.page_no, r.width, r.height) for r in pdf.pages(tables).where("file_id = 6").collect()} == {(1, 100.0, 100.0)}


def resources_of(how):
    """A page whose font 5 is there and whose form 40 and shading 41 aren't, with resources given in different ways."""
    o = simple()
    kinds = {"Font": {"F1": ref(5)}, "XObject": {"X": ref(40)}, "Shading": {"S": ref(41)}}
    o |= {5: {"Type": "/Font"}, 9: kinds, 10: kinds["XObject"], 11: kinds | {"XObject": ref(10)}}
    o[3] = {k: v for k, v in o[3].items() if k != "Resources"}
    given = {"inline": kinds, "indirect": ref(9), "kind": {"XObject": ref(10), "Font": {"F1": ref(5)}, "Shading": {"S": ref(41)}}, "both": ref(11), "missing": ref(50)}
    if how == "inherited":
        o[2] = o[2] | {"Resources": ref(9)}
    else:
        o[3] = o[3] | {"Resources": given[how]}
    return o


def parsed(spark, objects):
    rows = [(k, bytearray(build(o))) for k, o in enumerate(objects)]
    return pdf.tables_of(cut(spark.createDataFrame(rows, "file_id long, bytes binary").mapInArrow(pdf._parsed, pdf.PARSED)))


def test_missing_resources_inline_indirect_and_inherited(spark):
    ways = ["inline", "indirect", "kind", "both", "inherited", "missing"]
    t = parsed(spark, map(resources_of, ways))
    got = {(ways[r.file_id], r.page_no, r.resource, r.dst_num) for r in inspect.integrity_warnings(t).collect()}
    assert got == {(w, 1, "XObject", 40) for w in ways[:-1]} | {("missing", 1, "Resources", 50)}
    every = {(ways[r.file_id], r.resource, r.dst_num) for r in inspect.integrity_warnings(t, kinds=inspect.LISTED).collect()}
    assert every == {(w, k, n) for w in ways[:-1] for k, n in (("XObject", 40), ("Shading", 41))} | {("missing", "Resources", 50)}
    used = {(ways[r.file_id], r.name, r.dst_num) for r in pdf.page_resources(t, pdf.pages(t)).where("resource = 'Font' and name is not null").collect()}
    assert used == {(w, "F1", 5) for w in ways[:-1]}


def test_page_trees_of_any_depth_and_cycles(spark):
    deep = simple()
    deep[2] = {"Type": "/Pages", "Kids": [ref(100)], "MediaBox": [0, 0, 50, 60]}
    deep |= {100 + k: {"Type": "/Pages", "Kids": [ref(101 + k)]} for k in range(60)}
    deep[160] = {"Type": "/Page"}
    ring = simple()
    ring[2] = ring[2] | {"Kids": [ref(2), ref(3), ref(8)]}
    ring[8] = {"Type": "/Pages", "Kids": [ref(2), ref(9)]}
    ring[9] = {"Type": "/Page" + "x" * 2000, "Parent": ref(8)}
    t = parsed(spark, [deep, ring])
    got = {(r.file_id, r.page_no, r.obj_num, r.width) for r in pdf.pages(t).collect()}
    assert got == {(0, 1, 160, 50.0), (1, 1, 3, 612.0)}
    assert t.objects.where("obj_num = 9 and file_id = 1").first().type == "Page" + "x" * 2000


def test_object_streams_and_damage():
    inner = b"1 0 2 33 <</Type/Catalog/Pages 2 0 R     >> <</Type/Pages/Kids[]/Count 0>>"
    first = inner.index(b"<<")
    inner = inner.replace(b"2 33", b"2 %d" % (inner.index(b"<</Type/Pages") - first))
    first = inner.index(b"<<")
    packed = zlib.compress(inner)
    data = b"%PDF-1.5\n9 0 obj<</Type/ObjStm/N 2/First " + str(first).encode() + b"/Filter/FlateDecode/Length " + str(len(packed)).encode() + b">>stream\n" + packed + b"\nendstream endobj\n"
    objects, trailer = pdf.parse_file(data)
    assert objects[1][1] == {"Type": "/Catalog", "Pages": ref(2)} and objects[2][1]["Count"] == 0 and trailer["Root"] == ref(1)
    broken = build(simple()).replace(b"/Length 26", b"/Length 9999")
    assert pdf.parse_file(broken)[0][4][2] == simple()[4][1]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.parse_file(build(simple()).replace(b"trailer\n<<", b"trailer\n<</Encrypt 4 0 R "))


def test_inspection_accounts_for_everything(tables):
    items = inspect.inspect_items(tables)
    totals = inspect.category_totals(items)
    per = {r.file_id: (r.n, r.s) for r in totals.groupBy("file_id").agg({"n": "sum", "total_size": "sum"}).withColumnsRenamed({"sum(n)": "n", "sum(total_size)": "s"}).collect()}
    assert per == {k: (len(o), sum(len(v[1]) for v in o.values() if isinstance(v, tuple))) for k, o in FILES.items()}
    by = {(r.file_id, r.obj_num): r for r in items.collect()}
    assert by[2, 7].category == "Fonts" and by[2, 5].name == "Helvetica" and by[2, 4].name == "Page 1"
    assert by[3, 21].category == "Other Data" and by[3, 21].sub_category == "Graphics" and by[3, 20].category == "Metadata" and by[3, 1].category == "Document Structure"
    assert by[6, 5].category == "Images" and by[6, 5].name == "400 × 400 DeviceRGB"


def test_traits_and_audits(tables):
    by = {r.file_id: r for r in inspect.traits(tables).collect()}
    assert by[5].is_tagged and by[5].lang == "en-US" and by[5].has_struct_tree and by[1].marked_status == "missing"
    assert by[4].is_pdf_a and by[4].pdf_a_level == "1B" and not by[4].is_pdf_ua and by[3].title == "T" and by[3].xmp_language == "fr"
    assert {(r.file_id, r.elements, tuple(r.types), r.max_depth) for r in inspect.structure_stats(tables).collect()} == {(5, 4, ("Document", "Figure", "P"), 2)}
    assert {(r.file_id, r.total, r.with_it) for r in inspect.figure_coverage(tables).collect()} == {(5, 2, 1)}
    assert {(r.file_id, r.total, r.with_it) for r in inspect.to_unicode_coverage(tables).collect()} == {(2, 2, 1), (4, 2, 1)}
    assert inspect.integrity_warnings(tables).count() == 0


def test_image_plan(tables):
    plan = {r.obj_num: (r.reason, r.new_width, r.new_height) for r in passes.image_plan(tables, PRESETS["web"]).where("file_id = 6").collect()}
    assert plan[5] == (None, 208, 208) and plan[6] == ("smallImage", None, None) and plan[8][0] is None
    assert plan[7][0] == "smask"


def test_passes_count_and_account(optimised, files):
    data, counters = optimised
    assert data[99] == (b"not a pdf", True)
    for k, o in FILES.items():
        own = counters[k]
        first = own["Recompressing streams"]
        assert first.get("recompressed", 0) + first.get("skipped", 0) == len(o)
        assert len(data[k][0]) <= len(build(o))
        after, trailer = pdf.parse_file(data[k][0])
        if not data[k][1]:
            gone = 2 * own.get("Unembedding standard fonts", {}).get("unembedded", 0) + sum(own.get(p, {}).get("deduplicated", 0) for p in ("Deduplicating objects", "Deduplicating fonts"))
            xmp = int(k == 3)
            assert len(after) == len(o) - gone - xmp - own.get("Removing unreferenced objects", {}).get("removed", 0)
    assert counters[3]["Deduplicating objects"]["deduplicated"] == 2
    assert counters[3]["Stripping metadata"]["stripped"] == 3
    assert counters[2]["Unembedding standard fonts"]["unembedded"] == 1 and "Unembedding standard fonts" not in counters[4]


def test_results_are_sound(optimised):
    data, _ = optimised
    objects, _ = pdf.parse_file(data[3][0])
    assert objects[1][1] == {"Type": "/Catalog", "Pages": ref(2), "Lang": {"s": "6672"}}
    assert objects[3][1]["Resources"]["XObject"] == {"A": ref(21), "B": ref(21)} and "PieceInfo" not in objects[3][1] and 26 not in objects
    assert objects[4][2][:1] == b"\x78" and zlib.decompress(objects[4][2]) == b"0 0 m\n" * 400
    font = pdf.parse_file(data[2][0])[0][5][1]
    assert font == {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica", "Encoding": "/WinAnsiEncoding", "ToUnicode": ref(11)}
    assert 10 in pdf.parse_file(data[2][0])[0] and 7 in pdf.parse_file(data[4][0])[0]


def test_options(files):
    _, stats = passes.run(files.where("file_id = 2"), Options(unembed=False))
    assert stats.where("counter = 'unembedded'").count() == 0


@pytest.mark.parametrize(
    "encoded, filters, plain",
    [
        (zlib.compress(b"abc"), ["FlateDecode"], b"abc"),
        (zlib.compress(b"abc" * 50)[2:-4], ["Fl"], b"abc" * 50),
        (b"6 1 6\n2 6>", ["ASCIIHexDecode"], b"ab`"),
        (b"<~87cURD]i,\"Ebo80~>", ["A85"], b"Hello World!"),
        (b"z~>", ["ASCII85Decode"], bytes(4)),
        (bytes([2, 65, 66, 67, 254, 68, 128, 9]), ["RunLengthDecode"], b"ABCDDD"),
        (bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), ["LZWDecode"], bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])),
        (zlib.compress(b"x").hex().encode(), ["AHx", "Fl"], b"x"),
        (b"as is", None, b"as is"),
    ],
)
def test_filters(encoded, filters, plain):
    assert codecs.decode(encoded, filters) == plain


def test_prediction_and_downsampling():
    import numpy as np

    assert codecs.unpredicted(bytes([1, 1, 1, 1, 2, 1, 1, 1]), 3) == bytes([1, 2, 3, 2, 3, 4])
    assert codecs.unpredicted(bytes([4, 5, 5, 3, 1, 1]), 2) == bytes([5, 10, 3, 7])
    pixels = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert codecs.downsampled(pixels, 2, 2).ravel().tolist() == [3, 5, 11, 13]
    assert (codecs.downsampled(np.full((7, 5, 3), 9, np.uint8), 2, 3) == 9).all()


def test_tokens_and_used_codes(spark):
    data = b"BT /F1 12 Tf (He\\154lo\\)) Tj <4 1> Tj [(A) -20 (B)] TJ /F2 1 Tf (z) ' % note\nBI /W 1 ID \x01(x EI ET"
    kinds = [t[0] for t in tokens(data)]
    assert kinds.count("string") == 5 and kinds.count("operator") == 10
    table = tokenise(spark.createDataFrame([(1, "p1", bytearray(data))], "file_id long, scope_id string, data binary"))
    codes = {}
    for r in used_codes(table).collect():
        codes.setdefault(r.font, set()).add(r.code)
    assert codes == {"F1": set(b"Hello)A@B") - {64} | {0x41}, "F2": set(b"z")}


def test_font_dimensions():
    found = aliases()
    assert len(found) == 38 and "CourierNew-Bold" not in found
    assert found["Arial,BoldItalic"] == "Helvetica-BoldOblique" and found["TimesNewRomanPSMT"] == "Times-Roman" and found["CourierNew,Bold"] == "Courier-Bold" and found["Symbol"] == "Symbol"
    cmap = "2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert to_unicode(cmap) == [(1, "A"), (2, "😀"), (16, "a"), (17, "b"), (18, "c"), (32, "x"), (33, "y")]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(simple()))
    (tmp_path / "B.PDF").write_bytes(build(simple()))
    (tmp_path / "c.txt").write_bytes(b"no")
    found = pdf.read_files(spark, str(tmp_path))
    assert found.count() == 2 and pdf.read_pdf(found).objects.count() == 8
    assert all(re.search(r"(?i)\.pdf$", r.path) for r in found.collect())


def test_document_info_and_title(spark):
    text = lambda raw: {"s": raw.hex()}
    o = simple() | {7: {"Title": text(b"\xfe\xff" + "Čau".encode("utf-16-be")), "Author": text("é".encode("latin-1")), "Subject": text(b""), "Keywords": 3, "Producer": text(b"\xef\xbb\xbf" + "ž".encode()), "CreationDate": text(b"D:20240229123000+02'30'"), "ModDate": text(b"D:2023")}}
    t = pdf.tables_of(cut(spark.createDataFrame([(1, bytearray(build(o, info=7))), (2, bytearray(build(simple())))], "file_id long, bytes binary").mapInArrow(pdf._parsed, pdf.PARSED)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = inspect.document_info(t).selectExpr("*", "string(creation_date) as made", "string(modification_date) as changed").collect()
    spark.conf.set("spark.sql.session.timeZone", zone)
    got = {r.file_id: (r.page_count, r.title, r.author, r.subject, r.keywords, r.creator, r.producer, r.made, r.changed) for r in rows}
    assert got == {1: (1, "Čau", "é", None, None, None, "ž", "2024-02-29 10:00:00", "2023-01-01 00:00:00"), 2: (1, *[None] * 8)}
    assert {(r.file_id, r.title) for r in inspect.traits(t).collect()} == {(1, "Čau"), (2, None)}


def test_audit_bundle(tables):
    got = {r.file_id: (r.fonts_total, r.fonts_with_it, r.images, r.figures_total, r.figures_with_it, r.elements, r.max_depth) for r in inspect.audits(tables).collect()}
    none = (None,) * 4
    assert got == {1: (0, 0, 0, *none), 2: (2, 1, 0, *none), 3: (0, 0, 1, *none), 4: (2, 1, 0, *none), 5: (0, 0, 0, 2, 1, 4, 2), 6: (0, 0, 4, *none)}


def test_hint_and_tier(spark, tables):
    sizes = spark.createDataFrame([(1, 100, 50), (3, 100, 99), (6, 1000, 950)], "file_id long, original long, optimised long")
    totals = inspect.category_totals(inspect.inspect_items(tables))
    assert [r.file_id for r in inspect.lossy_hint(totals, sizes, False).collect()] == [6] and inspect.lossy_hint(totals, sizes, True).isEmpty()
    assert [r[0] for r in spark.createDataFrame([(50 << 20,), (20 << 20,), (5,)], "n long").select(batch_tier(F.col("n"))).collect()] == ["large", "medium", None]


def test_check_of_each_pass(files, monkeypatch):
    def breaking(t, _):
        return passes._without(t, t.objects.where("obj_num = 5").select("file_id", "obj_num")), t.objects.groupBy("file_id").count().selectExpr("file_id", "'left' as counter", "count as n")

    monkeypatch.setattr(passes, "PASSES", (("Breaking", breaking), ("Again", breaking)))
    t = pdf.tables_of(cut(files.where("file_id = 2").mapInArrow(pdf._parsed, pdf.PARSED)))
    _, stats = passes.optimize(t, Options(check_each_pass=True))
    assert [(r["pass"], r.counter, r.n) for r in stats.where("counter like 'dangling%'").collect()] == [("Breaking", "dangling:Font", 1)]
