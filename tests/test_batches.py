"""Per-file helpers hand over many rows a batch, and no more than a bounded number of bytes."""

import pyarrow as pa

from pdf_files import build, simple
from paperloom.functions import batches, tokens
from paperloom.session import cut
from paperloom.sinks import pdf as sink
from paperloom.sources import pdf

N = 100


def test_files_and_streams_share_batches():
    files = pa.RecordBatch.from_pydict({"file_id": list(range(N)), "bytes": [build(simple())] * N})
    parsed = list(pdf._parsed(iter([files])))
    assert len(parsed) == 1 and set(parsed[0].column("file_id").to_pylist()) == set(range(N))
    streams = pa.RecordBatch.from_pydict({"file_id": list(range(N)), "scope_id": ["1"] * N, "data": [b"BT /F1 1 Tf (a) Tj ET"] * N})
    found = list(tokens._tokenised(iter([streams])))
    assert len(found) == 1 and found[0].column("seq").to_pylist() == list(range(found[0].num_rows // N)) * N


def test_batches_are_bounded():
    schema = pa.schema([("a", pa.int64()), ("b", pa.binary())])
    big = [(k, b"x" * (batches.BYTES // 2)) for k in range(5)]
    assert [b.num_rows for b in batches.batched(iter(big), schema, lambda r: len(r[1]))] == [2, 2, 1]
    assert [b.num_rows for b in batches.batched(((k, b"") for k in range(batches.ROWS + 1)), schema, lambda r: 0)] == [batches.ROWS, 1]
    assert not list(batches.batched(iter([]), schema, len))


def test_files_are_written_without_a_call_for_each(spark):
    rows = [(k, bytearray(build(simple()))) for k in range(7)]
    t = pdf.tables_of(cut(spark.createDataFrame(rows, "file_id long, bytes binary").mapInArrow(pdf._parsed, pdf.PARSED)))
    written = sink.write_pdf(t)
    assert "FlatMapGroups" not in written._jdf.queryExecution().executedPlan().toString()
    assert {(r.file_id, bytes(r.bytes)) for r in written.collect()} == {(k, bytes(b)) for k, b in rows}


def test_trailer_is_a_word_of_its_own():
    data = b"%PDF-1.7\n1 0 obj\n<</Type /Catalog>>\nendobj\nnotrailer <</Root 9 0 R>>\ntrailer\n<</Root 1 0 R>>\n"
    assert pdf.parse_file(data)[1] == {"Root": {"r": [1, 0]}}
    assert pdf.parse_file(data.replace(b"\ntrailer", b"\ntrailers"))[1] == {"Root": {"r": [1, 0]}}  # none: the catalog is looked for
