"""Rows of per-row helpers, put together to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows, and bytes of their values, after which a batch is sent.
ROWS, BYTES = 4_000, 4 << 20


def batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """All rows, many a batch; ``size`` says how many bytes a row has. A batch is sent as soon as it has enough, so one holds no more than that and a row."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= ROWS or weight >= BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)
