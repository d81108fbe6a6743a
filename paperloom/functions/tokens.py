"""Content streams as tokens: a generator for one stream, and the Arrow function that applies it to a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import batched
from .pdfvalues import parse

SCHEMA = "file_id long, scope_id string, seq long, kind string, str binary, num double, name string, op string"


def tokens(data: bytes) -> Iterator[tuple[str, bytes | None, float | None, str | None, str | None]]:
    """(kind, string, number, name, operator) of each operand and operator. Inline images are skipped whole."""
    at = 0
    while True:
        try:
            value, at = parse(data, at)
        except (ValueError, RecursionError):
            return
        yield from _flat(value)
        if value == b"BI":
            end = data.find(b"EI", at)
            at = end if end >= 0 else len(data)


def _flat(value: object) -> Iterator[tuple]:
    if isinstance(value, bytes):
        yield ("operator", None, None, None, value.decode("latin-1"))
    elif isinstance(value, list):
        yield ("arrayStart", None, None, None, None)
        for v in value:
            yield from _flat(v)
        yield ("array", None, None, None, None)
    elif isinstance(value, dict) and set(value) == {"s"}:
        yield ("string", bytes.fromhex(value["s"]), None, None, None)
    elif isinstance(value, str):
        yield ("name", None, None, value[1:], None)
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield ("number", None, float(value), None, None)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("scope_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("str", pa.binary()), ("num", pa.float64()), ("name", pa.string()), ("op", pa.string())])
    for batch in batches:
        streams = zip(batch.column("file_id").to_pylist(), batch.column("scope_id").to_pylist(), batch.column("data"))
        rows = ((file_id, scope, k, *t) for file_id, scope, data in streams for k, t in enumerate(tokens(data.as_py() or b"")))
        yield from batched(rows, schema, lambda row: len(row[4] or b""))


def tokenise(streams: DataFrame) -> DataFrame:
    """Streams (file_id, scope_id, data) to a row per token, numbered within the stream."""
    return streams.select("file_id", "scope_id", "data").mapInArrow(_tokenised, SCHEMA)


def shown_strings(token_table: DataFrame) -> DataFrame:
    """file_id, scope_id, font, str: strings shown, with the last font set before them."""
    order = Window.partitionBy("file_id", "scope_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    set_font = F.when((F.lead("op", 2).over(order) == "Tf") & (F.col("kind") == "name"), F.col("name"))
    backwards = Window.partitionBy("file_id", "scope_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.last(F.when(F.col("kind") == "operator", F.col("op")), ignorenulls=True).over(backwards)
    marked = token_table.withColumn("font", set_font).withColumn("font", F.last("font", ignorenulls=True).over(before)).withColumn("shown", shown)
    return marked.where((F.col("kind") == "string") & F.col("shown").isin("Tj", "TJ", "'", '"') & F.col("font").isNotNull()).select("file_id", "scope_id", "font", "str")


def called_forms(token_table: DataFrame) -> DataFrame:
    """file_id, scope_id, name: names that ``Do`` is applied to."""
    order = Window.partitionBy("file_id", "scope_id").orderBy("seq")
    called = (F.lead("op").over(order) == "Do") & (F.col("kind") == "name")
    return token_table.withColumn("called", called).where("called").select("file_id", "scope_id", "name")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def distinct_codes(strings: pa.Array, wide: pa.Array) -> pa.Array:
    """Distinct codes of each string: two bytes each where ``wide`` (an odd last byte is none), else one."""
    found = (np.unique(np.frombuffer(s, ">u2", len(s) // 2)).tolist() if two else set(s) for s, two in zip((x.as_py() or b"" for x in strings), wide.to_pylist()))
    return pa.array(map(list, found), pa.list_(pa.int32()))


def used_codes(token_table: DataFrame) -> DataFrame:
    """file_id, scope_id, font, code: byte codes shown in each font. The font of a string is the last one set before it."""
    return shown_strings(token_table).select("file_id", "scope_id", "font", F.explode(distinct_codes("str", F.lit(False))).alias("code")).distinct()
