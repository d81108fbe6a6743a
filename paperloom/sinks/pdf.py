"""Tables back to PDF bytes, one file per group."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batched
from ..functions.pdfvalues import to_pdf
from ..sources.pdf import Tables


def serialized(objects: list[tuple[int, int, str, bytes | None]], trailer: dict) -> bytes:
    """A file with a classic cross-reference table."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, generation, text, body in sorted(objects, key=lambda o: o[0]):
        places[number] = (len(out), generation)
        value = json.loads(text)
        if body is not None:
            value["Length"] = len(body)
        out += b"%d %d obj\n" % (number, generation) + to_pdf(value)
        out += b"\nendobj\n" if body is None else b"\nstream\n" + body + b"\nendstream\nendobj\n"
    start, top = len(out), max(places, default=0) + 1
    out += b"xref\n0 %d\n" % top
    for n in range(top):
        out += b"%010d %05d n \n" % places[n] if n in places else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n" + to_pdf(trailer | {"Size": top}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def file(parts: pa.StructArray) -> tuple[bytes]:
        rows = list(zip(*(parts.field(c).to_pylist() for c in ("kind", "obj_num", "gen_num", "dict", "contents"))))
        trailer = {text: {"r": [number, generation]} for kind, number, generation, text, _ in rows if kind == "root"}
        return (serialized([r[1:] for r in rows if r[0] != "root"], trailer),)

    schema = pa.schema([("file_id", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        ids = batch.column("file_id").to_pylist()
        files = ((file_id, *file(parts.values)) for file_id, parts in zip(ids, batch.column("parts")))
        yield from batched(files, schema, lambda row: len(row[1]))


def write_pdf(t: Tables) -> DataFrame:
    """(file_id, bytes). A file is assembled where its objects meet, so a task holds one file."""
    roots = t.roots.select("file_id", F.lit("root").alias("kind"), F.col("dst_num").alias("obj_num"), F.col("dst_gen").alias("gen_num"), F.col("key").alias("dict"), F.lit(None).cast("binary").alias("contents"))
    rows = t.objects.select("file_id", "kind", "obj_num", "gen_num", "dict", "contents").unionByName(roots)
    parts = F.collect_list(F.struct("kind", "obj_num", "gen_num", "dict", "contents")).alias("parts")
    return rows.groupBy("file_id").agg(parts).mapInArrow(_assembled, "file_id long, bytes binary")


def guarded(before: DataFrame, after: DataFrame, warnings: DataFrame) -> DataFrame:
    """(file_id, bytes, kept_original): the original where the result is not smaller, is missing, or has integrity warnings."""
    bad = warnings.select("file_id").distinct().withColumn("_bad", F.lit(True))
    both = before.select("file_id", F.col("bytes").alias("_old")).join(after.withColumnRenamed("bytes", "_new"), "file_id", "left").join(bad, "file_id", "left")
    use_new = F.col("_bad").isNull() & F.coalesce(F.octet_length("_new") < F.octet_length("_old"), F.lit(False))
    return both.select("file_id", F.when(use_new, F.col("_new")).otherwise(F.col("_old")).alias("bytes"), (~use_new).alias("kept_original"))
