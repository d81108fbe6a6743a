"""Substring dedup with difference-cover anchors.

A window of ``WINDOW`` words that two documents share holds, at one and the same place in both, an
anchor of ``ANCHOR`` words that starts at a cover position (word number modulo ``PERIOD`` in
``COVER``) in either. So hashing anchors at cover positions only is enough to find every shared
window:

1. anchors go to hash buckets in packed form; each batch of documents sends an anchor that several
   of its documents have once, so a passage that a third of all documents hold stays small;
2. anchors of two or more documents come back as (document, position);
3. each such position extends to the windows around it, which are hashed in full (80 bits) and dealt
   to buckets in the same way; each window's smallest document is found there;
4. words under a window that starts in a smaller document are removed.

Defined results: null text has no words; texts shorter than a window lose nothing; rows with a null
``doc_id`` neither lose nor remove words; repeated rows of one ``doc_id`` lose the same words and
don't remove each other's; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, map_arrow, map_groups
from .hashing import SENT, chunks, sequences, slices, word_hashes
from .packed import SCHEMA, bucket_count, dealt, grouped, known, of_several, rows, unpack_all

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


#: Parts of hash in a record: 40 bits beside the bucket for anchors, 80 bits for windows.
_ANCHOR_HASH, _WINDOW_HASH = ("<u4", "<u1"), ("<u4", "<u4", "<u2")
_LOW = np.uint64(0xFFFFFFFF)


def _anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and position of each anchor of a batch, in order of row and position."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    hashes, docs, places = [], [], []
    for first, _, data, offsets in chunks(batch.column("text")):
        words, bounds = word_hashes(data, offsets)
        h = sequences(words, ANCHOR)
        if len(h) == 0:
            continue
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        pos = np.arange(len(words)) - bounds[row]
        keep = _IN_COVER[pos[: len(h)] % PERIOD] & (row[: len(h)] == row[ANCHOR - 1 :])
        hashes.append(h[keep])
        docs.append(ids[first + row[: len(h)][keep]])
        places.append(pos[: len(h)][keep])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hashes, np.uint64), join(docs, np.int64).astype(np.int64), join(places, np.int64)


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Buckets below ``buckets`` get one record of each anchor that the batch can't judge alone; those above, positions known to be shared."""
    for k, batch in enumerate(slices(batches, SENT)):
        h, doc, pos = _anchors(batch)
        if len(h) == 0:
            continue
        order, begin, size = grouped(h)
        several = of_several(order, begin, doc)
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(several, size)
        once = ~shared
        once[order[begin[several]]] = True  # one record of each shared anchor tells other batches of it
        sent = h[once]
        rest = sent // np.uint64(buckets)
        halves = [rest & _LOW, (rest >> np.uint64(32)) & np.uint64(0xFF)]
        out = dealt((sent % np.uint64(buckets)).astype(np.int64), halves, _ANCHOR_HASH, [doc[once], np.where(shared, -1, pos)[once]], buckets)
        yield rows(out + known(_ANCHOR_HASH, [doc[shared], pos[shared]], buckets + (int(h[0] % np.uint64(buckets)) + k) % buckets))


def _reply(group: pa.Table, buckets: int) -> pa.Table:
    """(doc_id, pos) of anchors that several documents have."""
    low, high, doc, pos = unpack_all(group, _ANCHOR_HASH, 2)
    if group.column("bucket")[0].as_py() < buckets:
        order, begin, size = grouped(low | high << np.uint64(32))
        several = of_several(order, begin, doc)
        doc, pos = doc[order], pos[order]
        several |= np.minimum.reduceat(pos, begin) < 0
        keep = np.repeat(several, size) & (pos >= 0)
        doc, pos = doc[keep], pos[keep]
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "pos": pa.array(pos.astype(np.int32), pa.int32())})


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, pos) of every anchor at a cover position that another document has at one; a few hash collisions more."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    sent = map_arrow(texts, lambda batches: _send(batches, buckets), SCHEMA)
    return map_groups(sent, "bucket", lambda group: _reply(group, buckets), "doc_id long, pos int")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]


def _windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows around shared anchors, like :func:`_send`: of each window the batch sends only its smallest document, and knows that the others repeat it."""
    for k, batch in enumerate(slices(batches, SENT)):
        batch = batch.filter(batch.column("found").is_valid())
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        found, at = _lists(batch.column("found"))
        parts = []
        for first, last, data, offsets in chunks(batch.column("text")):
            words, bounds = word_hashes(data, offsets)
            if len(words) < WINDOW:
                continue
            row = np.repeat(np.arange(last - first), np.diff(bounds))
            n = len(words) - WINDOW + 1
            anchor = found[at[first] : at[last]].astype(np.int64)
            owner = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
            mark = np.bincount(bounds[owner] + np.maximum(anchor - (WINDOW - ANCHOR), 0), minlength=len(words) + 1)
            mark = mark - np.bincount(bounds[owner] + anchor + 1, minlength=len(words) + 1)
            start = np.flatnonzero((np.cumsum(mark)[:n] > 0) & (row[:n] == row[WINDOW - 1 :]))
            a, b = sequences(words, WINDOW)[start], sequences(words, WINDOW, 1)[start] & np.uint64(0xFFFF)
            parts.append((a, b, ids[first + row[start]].astype(np.int64), start - bounds[row[start]]))
        a, b, doc, pos = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 4
        if len(a) == 0:
            continue
        order, begin, size = grouped(a ^ (b << np.uint64(48)))
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], begin), size)
        again = doc > least
        send = [x[~again] for x in (a, b, doc, pos)]
        out = dealt((send[0] % np.uint64(buckets)).astype(np.int64), [send[0] & _LOW, send[0] >> np.uint64(32), send[1]], _WINDOW_HASH, send[2:], buckets)
        yield rows(out + known(_WINDOW_HASH, [doc[again], pos[again]], buckets + (int(a[0] % np.uint64(buckets)) + k) % buckets))


def _judge(group: pa.Table, buckets: int) -> pa.Table:
    """(doc_id, start) of windows that a smaller document has too."""
    low, high, more, doc, pos = unpack_all(group, _WINDOW_HASH, 2)
    if group.column("bucket")[0].as_py() < buckets:
        order = np.lexsort((more, low | high << np.uint64(32)))
        low, high, more, doc, pos = (x[order] for x in (low, high, more, doc, pos))
        begin = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(more) != 0)])
        keep = doc > np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(doc)]))
        doc, pos = doc[keep], pos[keep]
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(pos.astype(np.int32), pa.int32())})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): word numbers at which a window starts that also starts in a smaller document."""
    texts = docs.select("doc_id", "text")
    buckets = bucket_count(docs)
    found = shared_anchors(docs, buckets).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("pos").alias("found"))
    near = texts.join(found, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "found")
    windows = map_arrow(near, lambda batches: _windows(batches, buckets), SCHEMA)
    again = map_groups(windows, "bucket", lambda group: _judge(group, buckets), "doc_id long, start int")
    return again.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("start").alias("starts"))


def _kept(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    """The words of each row that no repeated window covers."""
    for batch in slices(batches, SENT):
        starts, at = _lists(batch.column("starts"))
        texts, n_words, n_removed, out = batch.column("text").cast(pa.binary()).to_pylist(), [], [], []
        for k, text in enumerate(texts):
            words = (text or b"").split()  # bytes split at the six ASCII white-space characters
            n_words.append(len(words))
            here = starts[at[k] : at[k + 1]].astype(np.int64)
            if len(here):
                mark = np.bincount(here, minlength=len(words) + 1) - np.bincount(here + WINDOW, minlength=len(words) + 1)
                gone = np.cumsum(mark)[:-1] > 0
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone) if not g]
            else:
                n_removed.append(0)
            kept = b" ".join(words)
            out.append((text if not len(here) else kept) if full else hashlib.sha256(kept).hexdigest())
        rest = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        if full:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary()).cast(pa.string()), *rest], ["row", "kept", "n_words", "n_removed"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rest, pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents with their own columns; a text that loses words keeps the others, joined by one space, and one that loses all is empty."""
    found = cut(repeated_windows(docs))
    ids = found.select(F.col("of").alias("doc_id"))
    keyed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    kind = keyed.schema["row"].dataType.simpleString()
    # only texts that lose words meet their windows
    losing = join_small(keyed, ids, "doc_id", "left_semi").join(found, F.col("doc_id") == F.col("of")).select("text", "row", "starts")
    left = map_arrow(losing, lambda batches: _kept(batches, True), f"row {kind}, kept string, n_words long, n_removed long").select("row", F.col("kept").alias("text"))
    rest = join_small(keyed, ids, "doc_id", "left_anti").select("row", "text")
    return rest.unionByName(left).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    both = texts.join(repeated_windows(docs), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "starts")
    return map_arrow(both, lambda batches: _kept(batches, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, words[i:i + 12] AS x FROM w, unnest(range(1, len(words) - 11)) AS r(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM win) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(13)) AS k)
), lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ') AS kept
  FROM w LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""
