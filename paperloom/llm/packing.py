"""Packing: concatenate and cut, with two-pass prefix sums.

The first pass encodes every document once, writes its ids to the shared folder, and numbers tokens
within each partition. Prefix sums over the totals of the partitions (one row each) then give every
document its global offset, and the second pass cuts the stream at fixed windows: each document
yields one boundary record per window that it touches. Only the last sequence is not full.

Defined results: null texts are empty and consist of the end id; repeated rows are packed as often as
they occur; null ids are kept; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, map_arrow
from .encoding import Encoder

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 2, 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, drops_space: bool, end: int) -> Iterator[pa.RecordBatch]:
    """doc_id, ids (16 bits each where they fit), part, and the number of the document's first token in its part."""
    tokens, part, at = Encoder(path, drops_space, end), TaskContext.get().partitionId(), 0
    width = "<u2" if max(end, tokens.tokenizer.get_vocab_size()) < 1 << 16 else "<u4"
    for batch in batches:
        for i, j, ids, size in tokens.encode(batch.column("text")):
            ends = np.cumsum(size)
            data = pa.py_buffer(ids.astype(width))
            offsets = pa.py_buffer(np.r_[0, ends * int(width[2])].astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, data])
            start = pa.array(at + ends - size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), packed, pa.array(size), pa.array(np.full(j - i, part, np.int64)), start], ["doc_id", "ids", "n", "part", "at"])
            at += int(ends[-1])


def encoded(docs: DataFrame, path: str, drops_space: bool, end: int) -> DataFrame:
    """First pass, written once: doc_id, ids, n, part, at."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(map_arrow(docs.select("doc_id", "text"), lambda b: _encoded(b, path, drops_space, end), f"doc_id {kind}, ids binary, n long, part long, at long"))


def part_bases(parts: DataFrame) -> DataFrame:
    """(part, base): tokens in the parts before. The window sees one row per part."""
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))


def _pieces(batches: Iterator[pa.RecordBatch], length: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, first = (batch.column(c).to_numpy() for c in ("n", "first"))
        count = (first + n - 1) // length - first // length + 1
        row = np.repeat(np.arange(len(n)), count)
        window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (first // length)[row]
        begin = np.maximum(window * length, first[row])
        size = np.minimum((window + 1) * length, (first + n)[row]) - begin
        start = begin - first[row]
        width = [f"<u{len(x) // m}" if m else "<u2" for x, m in zip((v.as_py() for v in batch.column("ids")), n.tolist())]
        texts = [np.frombuffer(v.as_buffer(), w).astype("<u4") for v, w in zip(batch.column("ids"), width)]
        pieces = [texts[r][s : s + m].tobytes() for r, s, m in zip(row.tolist(), start.tolist(), size.tolist())]
        last = pa.array(pieces, pa.binary()) if whole else pa.array([zlib.crc32(p) for p in pieces], pa.int64())
        columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size)), last, *map(pa.array, (n[row], window, begin - window * length))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids" if whole else "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, length: int = LENGTH, drops_space: bool = True, whole: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (or their crc32), doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    parts = encoded(docs, tokenizer or tokenizer_path(TOKENIZER), drops_space, end)
    placed = join_small(parts, cut(part_bases(parts)), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("at")).alias("first"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    value = "ids binary" if whole else "ids_crc32 long"
    return map_arrow(placed, lambda b: _pieces(b, length, whole), f"doc_id {kind}, start long, length long, {value}, doc_tokens long, sequence_id long, offset long")


def op8(docs: DataFrame) -> DataFrame:
    return pack(docs, whole=False)
