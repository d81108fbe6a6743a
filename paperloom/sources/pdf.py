"""PDF files as tables: files, objects, refs, roots, pages.

``binaryFile`` reads the files, one row each; each row is parsed in a task into its indirect objects,
and everything after that is joins and aggregations. A file that can't be read becomes an error row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import batched
from ..functions.codecs import decode
from ..functions.pdfvalues import parse, references, to_json
from ..session import cut

PARSED = "file_id long, kind string, obj_num int, gen_num int, dict string, contents binary, refs array<struct<key_path: array<string>, dst_num: int, dst_gen: int>>, error string"
#: Trailer entries that root the object graph.
ROOTS = ("Root", "Info", "Encrypt", "ID")
_STREAM, _END = re.compile(rb"[\s\x00]*stream(?=[\r\n])"), re.compile(rb"[\s\x00]*endstream")
_TRAILER = re.compile(rb"trailer\b")
_OBJ = re.compile(rb"(?<![0-9])(\d+)[\s\x00]+(\d+)[\s\x00]+obj\b")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, path, bytes, length of files whose name ends in .pdf, whatever the case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.lower("path").endswith(".pdf"))
    return kept.select(F.xxhash64("path").alias("file_id"), "path", F.col("content").alias("bytes"), "length")


def _number(value: object, objects: dict) -> int | None:
    """A whole number, direct or by reference."""
    if isinstance(value, dict) and "r" in value:
        value = objects.get(value["r"][0], (0, None, None))[1]
    return value if isinstance(value, int) else None


def _stream(data: bytes, at: int, header: dict, length: int | None) -> bytes:
    start = at + (2 if data[at : at + 2] == b"\r\n" else 1)
    if length is not None and _END.match(data[start + length : start + length + 16]):
        return data[start : start + length]
    end = data.find(b"endstream", start)
    body = data[start : end if end >= 0 else len(data)]
    return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body.endswith((b"\n", b"\r")) else body


def parse_file(data: bytes) -> tuple[dict[int, tuple[int, object, bytes | None]], dict]:
    """(objects by number: generation, value, stream bytes; trailer). Scans for objects, so damaged cross-reference tables don't matter; later definitions win."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("invalid PDF: no header")
    objects, streams, trailer, at = {}, {}, {}, 0
    while m := _OBJ.search(data, at):
        try:
            value, end = parse(data, m.end())
        except ValueError:
            at = m.end()
            continue
        number, generation, at = int(m[1]), int(m[2]), end
        body = _STREAM.match(data, end) if isinstance(value, dict) else None
        if body:
            streams[number] = (body.end(), value)
            known = _number(value.get("Length"), objects)
            at = body.end() + (known or 0) if known and b"endstream" in data[body.end() + known : body.end() + known + 20] else max(data.find(b"endstream", body.end()), body.end())
        objects[number] = (generation, value, None)
    for number, (place, header) in streams.items():
        if objects[number][1] is header:
            objects[number] = (objects[number][0], header, _stream(data, place, header, _number(header.get("Length"), objects)))
    for m in _TRAILER.finditer(data):
        if re.match(rb"\w", data[max(m.start() - 1, 0) : m.start()]):
            continue  # a leading \b in the pattern would keep the search from looking for the word
        try:
            value, _ = parse(data, m.end())
            trailer |= value if isinstance(value, dict) else {}
        except ValueError:
            continue
    for number in [n for n, (_, v, b) in objects.items() if b is not None and isinstance(v, dict)]:
        generation, header, body = objects[number]
        if header.get("Type") == "/XRef":
            trailer = {k: header[k] for k in ROOTS if k in header} | trailer
            del objects[number]
        elif header.get("Type") == "/ObjStm" and "Encrypt" not in trailer:
            names = header.get("Filter")
            plain = decode(body, [n[1:] for n in ([names] if isinstance(names, str) else names or [])])
            head = [int(x) for x in plain[: header["First"]].split()]
            for inner, offset in zip(head[::2], head[1::2]):
                if inner not in objects:
                    objects[inner] = (0, parse(plain, header["First"] + offset)[0], None)
            del objects[number]
    if "Encrypt" in trailer:
        raise ValueError("the file is encrypted")
    if "Root" not in trailer:
        found = [n for n, (_, v, _) in objects.items() if isinstance(v, dict) and v.get("Type") == "/Catalog"]
        if not found:
            raise ValueError("invalid PDF: no catalog")
        trailer["Root"] = {"r": [found[-1], objects[found[-1]][0]]}
    return objects, trailer


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("key_path", pa.list_(pa.string())), ("dst_num", pa.int32()), ("dst_gen", pa.int32())])
    schema = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("obj_num", pa.int32()), ("gen_num", pa.int32()), ("dict", pa.string()), ("contents", pa.binary()), ("refs", pa.list_(kind)), ("error", pa.string())])
    edges = lambda value: [{"key_path": list(p), "dst_num": n, "dst_gen": g} for p, n, g in references(value)]

    def rows_of(file_id: int, data: bytes) -> list[tuple]:
        try:
            objects, trailer = parse_file(data)
            rows = [(file_id, "object", n, g, to_json(v), b, edges(v), None) for n, (g, v, b) in objects.items()]
            return rows + [(file_id, "root", None, None, to_json({k: trailer[k]}), None, edges({k: trailer[k]}), None) for k in ROOTS if k in trailer]
        except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
            return [(file_id, "error", None, None, None, None, [], str(e)[:200])]

    for batch in batches:
        files = zip(batch.column("file_id").to_pylist(), batch.column("bytes"))
        rows = (row for file_id, data in files for row in rows_of(file_id, data.as_py()))
        yield from batched(rows, schema, lambda row: len(row[4] or "") + len(row[5] or b""))


@dataclass(frozen=True)
class Tables:
    """The tables of a corpus. ``dict`` is JSON text; passes return new tables."""

    objects: DataFrame
    refs: DataFrame
    roots: DataFrame
    errors: DataFrame


def name_of(key: str, column: str = "dict"):
    """A name entry of the JSON dictionary, without its slash; null for other types."""
    value = F.get_json_object(column, f"$.{key}")
    return F.when(value.startswith("/"), value.substr(F.lit(2), F.length(value)))


def ref_of(key: str, column: str = "dict"):
    """Object number of a reference entry."""
    return F.get_json_object(column, f"$.{key}.r[0]").cast("int")


def read_pdf(files: DataFrame) -> Tables:
    """Parses files (file_id, bytes). Cache or checkpoint the result if it is used more than once."""
    parsed = files.select("file_id", "bytes").mapInArrow(_parsed, PARSED)
    return tables_of(parsed)


def tables_of(parsed: DataFrame) -> Tables:
    found = parsed.where("kind = 'object'")
    objects = found.select(
        "file_id", "obj_num", "gen_num", F.when(F.col("contents").isNotNull(), "stream").when(F.col("dict").startswith("{"), "dict").when(F.col("dict").startswith("["), "array").otherwise("scalar").alias("kind"),
        name_of("Type").alias("type"), name_of("Subtype").alias("subtype"), "dict", "contents", F.coalesce(F.octet_length("contents"), F.lit(0)).cast("long").alias("size"),
    )
    edge = found.select("file_id", F.col("obj_num").alias("src_num"), F.col("gen_num").alias("src_gen"), F.explode("refs").alias("e"))
    refs = edge.select("file_id", "src_num", "src_gen", "e.key_path", "e.dst_num", "e.dst_gen")
    root = parsed.where("kind = 'root'").select("file_id", F.explode("refs").alias("e"))
    roots = root.select("file_id", F.col("e.key_path")[0].alias("key"), "e.dst_num", "e.dst_gen")
    return Tables(objects, refs, roots, parsed.where("kind = 'error'").select("file_id", "error"))


def pages(t: Tables) -> DataFrame:
    """file_id, page_no (from 1), obj_num, gen_num, width, height, resources, in page tree order.

    Walks /Kids level by level with the path of positions as the order, as deep as the tree is; a kid
    that is its own ancestor is left out. Boxes and resources are inherited: ``resources`` is the number
    of the nearest node with /Resources.
    """
    entry = lambda key: F.get_json_object("dict", f"$.{key}")
    nodes = t.objects.where("type in ('Pages', 'Page')").select("file_id", "obj_num", "gen_num", "type", entry("MediaBox").alias("box"), entry("Resources").isNotNull().alias("own"))
    kids = t.refs.where((F.col("key_path")[0] == "Kids") & (F.size("key_path") == 2)).select("file_id", F.col("src_num").alias("obj_num"), F.col("key_path")[1].cast("int").alias("place"), F.col("dst_num").alias("kid"))
    catalog = t.roots.where("key = 'Root'").join(t.objects.withColumnRenamed("obj_num", "dst_num"), ["file_id", "dst_num"])
    none = F.array().cast("array<int>")
    level = catalog.select("file_id", ref_of("Pages").alias("obj_num"), none.alias("path"), none.alias("above"), F.lit(None).cast("string").alias("inherited"), F.lit(None).cast("int").alias("holder"))
    found = None
    while True:
        here = level.join(nodes, ["file_id", "obj_num"]).withColumn("box", F.coalesce("box", "inherited")).withColumn("holder", F.when(F.col("own"), F.col("obj_num")).otherwise(F.col("holder")))
        leaves = here.where("type = 'Page'").select("file_id", "obj_num", "gen_num", "path", "box", "holder")
        found = leaves if found is None else found.unionByName(leaves)
        inner = here.where("type = 'Pages'").withColumn("above", F.array_append("above", F.col("obj_num")))
        level = inner.join(kids, ["file_id", "obj_num"]).where(~F.array_contains("above", F.col("kid")))
        level = cut(level.select("file_id", F.col("kid").alias("obj_num"), F.array_append("path", F.col("place")).alias("path"), "above", F.col("box").alias("inherited"), "holder"))
        if level.isEmpty():
            break
    box = F.from_json("box", "array<double>")
    order = Window.partitionBy("file_id").orderBy("path")
    return found.select("file_id", F.row_number().over(order).alias("page_no"), "obj_num", "gen_num", F.abs(box[2] - box[0]).alias("width"), F.abs(box[3] - box[1]).alias("height"), F.col("holder").alias("resources"))


def page_resources(t: Tables, page_table: DataFrame) -> DataFrame:
    """file_id, page_no, page, resource (Font, XObject, ...), name, dst_num: what pages use through /Resources, inline, behind a reference, or inherited.

    A resource dictionary, or one of its kinds, that is a reference itself is listed too, without a name.
    """
    page = page_table.select("file_id", "page_no", F.col("obj_num").alias("page"), F.col("resources").alias("src_num"))
    refs = t.refs.select("file_id", "src_num", "key_path", "dst_num")
    rest = lambda n: F.slice("key_path", n + 1, F.greatest(F.size("key_path") - n, F.lit(0))).alias("rest")
    follow = lambda df, *kept: df.select("file_id", "page_no", "page", *kept, F.col("dst_num").alias("src_num")).join(refs, ["file_id", "src_num"])
    held = page.join(refs.where(F.col("key_path")[0] == "Resources"), ["file_id", "src_num"]).select("file_id", "page_no", "page", rest(1), "dst_num")
    whole = held.where(F.size("rest") == 0)
    inside = held.where(F.size("rest") > 0).unionByName(follow(whole).select("file_id", "page_no", "page", rest(0), "dst_num"))
    kind = F.get("rest", F.lit(0)).alias("resource")
    kinds = inside.where(F.size("rest") == 1).select("file_id", "page_no", "page", kind, "dst_num")
    direct = inside.where(F.size("rest") == 2).select("file_id", "page_no", "page", kind, F.get("rest", F.lit(1)).alias("name"), "dst_num")
    behind = follow(kinds, "resource").where(F.size("key_path") == 1).select("file_id", "page_no", "page", "resource", F.col("key_path")[0].alias("name"), "dst_num")
    nameless = whole.select("file_id", "page_no", "page", F.lit("Resources").alias("resource"), "dst_num").unionByName(kinds).withColumn("name", F.lit(None).cast("string"))
    return direct.unionByName(behind).unionByName(nameless)
