"""Vectorised word hashes of Arrow text columns: the text work inside tasks.

A word is a run of bytes other than the six ASCII white-space characters, so words never depend on
how a text is decoded. Word hashes are multilinear over the bytes, with fixed random coefficients,
and finished by a 64-bit mixer; hashes of word sequences combine those of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_STEP = _RANDOM.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are taken together up to this many bytes, so that the arrays of one step stay small.
CHUNK = 1 << 19
#: Bytes of text whose hashes are sent, and matched with each other, together.
SENT = 4 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their byte offsets from 0); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield row, last, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def slices(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, so that arrays over a batch stay small."""
    for batch in batches:
        for first, last, _, _ in chunks(batch.column(column), size):
            yield batch.slice(first, last - first)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the offsets of each row's words."""
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_row = offsets[:-1][offsets[:-1] < len(data)]
    begins[at_row] = inside[at_row]  # a row's first byte begins a word, whatever the row before ends with
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    which = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(which, 0)]
    value = _BYTE[data] * _PLACE[place & 4095]
    if len(data) > 4096 and place.max() > 4095:  # words longer than the table of places
        value *= np.uint64(2) * (place >> 12).astype(np.uint64) * _STEP[0, 63] + np.uint64(1)
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets).astype(np.int64)


def sequences(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each word on; there are ``len(words) - n + 1``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * _STEP[which, k]
    return mixed(out)
