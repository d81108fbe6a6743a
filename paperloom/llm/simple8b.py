"""Token-id output: Simple-8b word-aligned coding, in files with per-block offsets.

Coding. A 64-bit word holds a selector in its top 4 bits and as many ids as fit in the other 60;
selectors 0 to 13 stand for the counts in COUNTS. Values of 60 bits or more are escapes: a word with
selector 15, then the value as a word of its own. Ids are coded in blocks of BLOCK, each of which
starts at a word of its own, so blocks are coded and decoded side by side.

File. Magic, the words, the length and the id of each document and the first word of each block as
64-bit integers, then counts (documents, ids, blocks, words, documents with a null id) and magic; all
little-endian. So a file is written as its words come, and read from any block on. A partition of
documents, in ascending order, fills files of at least FILE_IDS ids; names sort in document order.

Recovery. A task writes each file under a name of its own and then renames it, so a task that runs
again or twice leaves the same files. The manifest (one row per file) is checkpointed and is what
readers trust.

Defined results: null texts are empty and consist of the end id; rows with a null ``doc_id`` come
first; repeated rows are written as often as they occur; an empty table writes no file; ``doc_id``
has to be a column of integers.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, input_bytes, join_small, map_arrow, shared_dir
from .encoding import Encoder
from .packing import tokenizer_path

TOKENIZER, END = "byte_bpe_50k.json", 0
#: Ids in a word, by selector; each has 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE, BLOCK, FILE_IDS = 15, 1024, 8_000_000
#: Ids coded, and blocks decoded, in one step.
SLICE = 512 * BLOCK
#: Bytes of text in a partition, at most; more partitions if the session asks for them.
PARTITION_BYTES = 64 << 20
MAGIC = b"S8BTOK01"

_BITS = np.frexp(np.arange(1 << 17))[1].astype(np.uint8)  # length in bits of small values


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of an array of unsigned integers."""
    small = len(ids) == 0 or int(ids.max()) < len(_BITS)
    ids = ids.astype(np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    bits = np.zeros(n + int(COUNTS[0]), np.uint8)
    if small:
        bits[:n] = _BITS[ids.astype(np.uint32)]
    for b in range(0 if small else 64):  # length in bits of each value; stops at the longest
        more = ids >> np.uint64(b) != 0
        if not more.any():
            break
        bits[:n] += more
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.int16)
    selector = np.full(n, ESCAPE, np.uint8)
    longest, done = bits[:n].copy(), 1  # longest value among the next `done`
    for s in range(len(COUNTS) - 1, -1, -1):
        while done < COUNTS[s]:
            np.maximum(longest, bits[done : done + n], out=longest)
            done += 1
        fits = longest <= 60 // COUNTS[s]
        if not fits.any() and s < len(COUNTS) - 1:
            break  # nor will more of them
        np.copyto(selector, np.uint8(s), where=fits & (left >= COUNTS[s]))  # larger counts overwrite smaller
    takes = np.r_[COUNTS, 0, 1][selector]
    # blocks step side by side from word to word
    at, chosen, owner = np.arange(blocks) * BLOCK, [], []
    end = np.minimum(at + BLOCK, n)
    live = np.arange(blocks)
    while len(live):
        chosen.append(at[live])
        owner.append(live)
        at[live] += takes[at[live]]
        live = live[at[live] < end[live]]
    first = np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    kind = selector[first]
    size = 1 + (kind == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(len(COUNTS)):
        here = np.flatnonzero(kind == s)
        width, word = np.uint64(60 // COUNTS[s]), np.full(len(here), np.uint64(s) << np.uint64(60))
        for k in range(COUNTS[s]):
            word |= ids[first[here] + k] << (width * np.uint64(k))
        words[place[here]] = word
    here = np.flatnonzero(kind == ESCAPE)
    words[place[here]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[here] + 1] = ids[first[here]]
    return words, place[np.searchsorted(first, np.arange(blocks) * BLOCK)]


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids; the offsets let blocks find their escapes side by side."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    at, end = offsets.astype(np.int64).copy(), np.r_[offsets[1:], len(words)].astype(np.int64)
    if (selector >= len(COUNTS)).any():  # perhaps escapes: step through each block
        live = np.flatnonzero(at < end)
        while len(live):
            escape = selector[at[live]] == ESCAPE
            raw[at[live][escape] + 1] = True
            at[live] += 1 + escape
            live = live[at[live] < end[live]]
    raw = raw[:-1]
    counts = np.where(raw, 1, np.r_[COUNTS, 0, 0][selector])
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[start[raw]] = words[raw]
    for s in range(len(COUNTS)):
        here = np.flatnonzero((selector == s) & ~raw)
        width = np.uint64(60 // COUNTS[s])
        mask = (np.uint64(1) << width) - np.uint64(1)
        for k in range(COUNTS[s]):
            out[start[here] + k] = (words[here] >> (width * np.uint64(k))) & mask
    return out


class Writer:
    """Writes one file as ids come; holds no more than a slice of ids, and the index."""

    def __init__(self, out):
        self.out, self.held, self.n_held = out, [], 0
        self.lengths, self.docs, self.offsets, self.n_ids, self.n_words, self.nulls = [], [], [], 0, 0, 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, lengths: np.ndarray, docs: pa.Array) -> None:
        self.lengths.append(lengths.astype("<i8"))
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls += docs.null_count
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SLICE:
            self._code(self.n_held // SLICE * SLICE)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint64)
        for k in range(0, n, SLICE):
            words, first = encode(ids[k : min(k + SLICE, n)])
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append((first + self.n_words).astype("<i8"))
            self.n_words += len(words)
        self.n_ids += n
        self.held, self.n_held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        self._code(self.n_held)
        index = [np.concatenate([np.zeros(0, "<i8"), *x]) for x in (self.lengths, self.docs, self.offsets)]
        for part in index:
            self.out.write(part.tobytes())
        self.out.write(np.array([len(index[0]), self.n_ids, len(index[2]), self.n_words, self.nulls], "<i8").tobytes() + MAGIC)


class Reader:
    """A file's index, and the ids of any of its documents."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC or bytes(data[len(data) - 8 :]) != MAGIC:
            raise ValueError("not a whole token file")
        docs, self.n_ids, blocks, words, nulls = (int(x) for x in np.frombuffer(data, "<i8", 5, len(data) - 48))
        at = 8 + 8 * words
        self.words = np.frombuffer(data, "<u8", words, 8)
        self.lengths, self.doc_ids = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.offsets = np.r_[np.frombuffer(data, "<i8", blocks, at + 16 * docs), words]
        self.nulls = np.arange(docs) < nulls  # they come first
        self.ends = np.cumsum(self.lengths)
        if docs and self.ends[-1] != self.n_ids:
            raise ValueError(f"{self.ends[-1]} ids in documents where the file says {self.n_ids}")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from number ``first`` on, before ``last``; only their blocks are decoded."""
        i, j = first // BLOCK, -(-last // BLOCK)
        at, end = self.offsets[i], self.offsets[j]
        return decode(self.words[at:end], self.offsets[i:j] - at)[first - i * BLOCK : last - i * BLOCK]

    def groups(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents with about a slice of ids each, one document at least."""
        i = 0
        while i < len(self.ends):
            before = self.ends[i] - self.lengths[i]
            j = max(i + 1, int(np.searchsorted(self.ends, before + SLICE, "right")))
            yield i, j
            i = j


def to_file(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a file whose documents are numbered from 0."""
    out = io.BytesIO()
    writer = Writer(out)
    writer.add(ids, lengths, pa.array(np.arange(len(lengths))))
    writer.close()
    return out.getvalue()


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, length of each document)."""
    file = Reader(data)
    parts = [file.ids(int(file.ends[i] - file.lengths[i]), int(file.ends[j - 1])) for i, j in file.groups()]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), file.lengths


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(place, recursive=True)
    tokens, part, number = Encoder(path, False, end), TaskContext.get().partitionId(), 0
    own = writer = None

    def closed() -> pa.RecordBatch:
        nonlocal number, writer
        writer.close()
        writer.out.close()
        name = f"part-{part:06d}-{number:06d}.s8b"
        store.move(own, f"{place}/{name}")
        row = [pa.array([name]), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([writer.n_ids], pa.int64())]
        number, writer = number + 1, None
        return pa.RecordBatch.from_arrays(row, ["file", "part", "number", "n"])

    for batch in batches:
        for i, j, ids, size in tokens.encode(batch.column("text")):
            if writer is None:
                own = f"{place}/.{part:06d}-{number:06d}-{uuid.uuid4().hex}"
                writer = Writer(store.open_output_stream(own))
            writer.add(ids, size, batch.column("doc_id").slice(i, j - i))
            if writer.n_ids >= FILE_IDS:
                yield closed()
    if writer is not None:
        yield closed()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes the files in ascending order of doc_id; returns the manifest: file, part, number, n, base (ids before the file)."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs, "text") // PARTITION_BYTES)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = whole.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = cut(map_arrow(ordered, lambda b: _write(b, folder, path, end), "file string, part long, number long, n long"))
    before = F.sum("n").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return cut(manifest.withColumn("base", before))  # one row per file


def _read(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            file, name = Reader(batch.column("content")[k].as_buffer()), batch.column("file")[k].as_py()
            for i, j in file.groups():
                start, lengths = file.ends[i:j] - file.lengths[i:j], file.lengths[i:j]
                data = memoryview(file.ids(int(start[0]), int(file.ends[j - 1])).astype("<u4").tobytes())
                at = 4 * (start - start[0])
                pieces = [data[p : p + 4 * m] for p, m in zip(at.tolist(), lengths.tolist())]
                last = pa.array([bytes(p) for p in pieces], pa.binary()) if whole else pa.array([zlib.crc32(p) for p in pieces], pa.int64())
                columns = [pa.array([name] * (j - i)), pa.array(file.doc_ids[i:j].astype(np.int64), mask=file.nulls[i:j]), pa.array(start), pa.array(lengths.astype(np.int64)), last]
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "at", "n_tokens", "ids" if whole else "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and the ids (or their crc32) of each document, from the files of the manifest."""
    value = "ids" if whole else "ids_crc32"
    if manifest.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {value} {'binary' if whole else 'long'}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    found = map_arrow(named, lambda b: _read(b, whole), f"file string, doc_id long, at long, n_tokens long, {value} {'binary' if whole else 'long'}")
    return join_small(found, manifest.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", value)


def op10(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(spark, folder, write_tokens(docs, folder), whole=False)
