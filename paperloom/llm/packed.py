"""Packed exchange of hash records: a row holds all records that a batch sends to one bucket.

A plain row for each hash costs two to three times the bytes of the hash itself. Here hashes are kept
as fixed-width columns, and documents and positions as differences split into 16-bit columns, most
of which are zero and vanish when shuffle files are compressed. The number of buckets follows the
input, so a bucket's size doesn't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import input_bytes

#: Bytes of text that one bucket stands for.
BUCKET_BYTES = 4 << 20
SCHEMA = "bucket long, packed binary"
_16 = np.uint64(0xFFFF)


def bucket_count(docs: DataFrame, column: str = "text") -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs, column) // BUCKET_BYTES))


def pack(hashes: list[np.ndarray], kinds: tuple[str, ...], places: list[np.ndarray]) -> bytes:
    """Columns of hash parts with their types, then integers as differences."""
    parts = [h.astype(kind).tobytes() for h, kind in zip(hashes, kinds)]
    for place in places:
        d = np.diff(place.astype(np.int64), prepend=np.int64(0)).view(np.uint64)
        parts += [((d >> np.uint64(16 * k)) & _16).astype("<u2").tobytes() for k in range(4)]
    return b"".join(parts)


def unpack(data: bytes, kinds: tuple[str, ...], places: int) -> list[np.ndarray]:
    """The hash parts, then the integers."""
    widths = [int(kind[2]) for kind in kinds]
    n, at, out = len(data) // (sum(widths) + 8 * places), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.frombuffer(data, kind, n, at).astype(np.uint64))
        at += n * width
    for _ in range(places):
        d = np.zeros(n, np.uint64)
        for k in range(4):
            d |= np.frombuffer(data, "<u2", n, at).astype(np.uint64) << np.uint64(16 * k)
            at += 2 * n
        out.append(np.cumsum(d.view(np.int64)))
    return out


def unpack_all(group: pa.Table, kinds: tuple[str, ...], places: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(v, kinds, places) for v in group.column("packed").to_pylist()))]


def dealt(bucket: np.ndarray, hashes: list[np.ndarray], kinds: tuple[str, ...], places: list[np.ndarray], buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed) for each bucket that gets records, which keep their order."""
    by = np.argsort(bucket, kind="stable")
    hashes, places = [h[by] for h in hashes], [p[by] for p in places]
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    return [(b, pack([h[i:j] for h in hashes], kinds, [p[i:j] for p in places])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]


def known(kinds: tuple[str, ...], places: list[np.ndarray], bucket: int) -> list[tuple[int, bytes]]:
    """Records that need no judgement, for a bucket that only spreads them."""
    return [(bucket, pack([np.zeros(len(places[0]), np.uint64)] * len(kinds), kinds, places))] if len(places[0]) else []


def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.binary())], ["bucket", "packed"])


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, and begin and size of each run of equal hashes."""
    order = np.argsort(h, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
    return order, begin, np.diff(np.r_[begin, len(h)])


def of_several(order: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each run has more than one document."""
    return np.minimum.reduceat(doc[order], begin) != np.maximum.reduceat(doc[order], begin)
