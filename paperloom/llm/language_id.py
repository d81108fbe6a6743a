"""Language ID by prediction by partial matching.

For each language a context tree over bytes is counted up to ORDER bytes of context, on a bounded
sample of labelled documents, and then frozen. The code length of a byte follows PPM with escape
method C: from the longest known context down, a byte that a context has seen costs
``-log2(n / (total + distinct))``, one that it hasn't seen costs the escape
``-log2(distinct / (total + distinct))`` and goes on to the next shorter context; below order 0 a byte
costs 8 bits. Since the statistics are frozen, these sums are worked out once for every string of
up to ORDER + 1 bytes that any language has seen, and whole texts are scored by table look-ups. The
language with the shortest code wins; the score is its posterior under equal priors.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything
if there is nothing to learn from; ties go to the language first in code point order; a null
``doc_id`` is neither held out nor learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, released
from .hashing import chunks

ORDER = 4
#: Bounds of the sample that is learned from: documents of each language, taken by hash of doc_id, and bytes of a text.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 16
#: A document is rejected if no language codes it in this many bits a byte.
MAX_BITS = 7.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PAD = 32


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, with ORDER blanks before each row, folded to lower case: ASCII and the capitals after 0xC3."""
    rows = len(offsets) - 1
    out = np.full(len(data) + ORDER * rows, _PAD, np.uint8)
    at = offsets + ORDER * np.arange(rows + 1)
    shift = np.repeat(at[:-1] + ORDER - offsets[:-1], np.diff(offsets))
    folded = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][capital] += 0x20
    out[np.arange(len(data)) + shift] = folded
    return out, at


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Number of the ``n`` bytes that end at each position from ORDER on."""
    out = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(n - 1, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - k : len(data) - k].astype(np.uint64)
    return out


class Table:
    """Strings of one length to row numbers: open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rows = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, winner = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[winner]
            self.keys[at[won]], self.rows[at[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.rows[at], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (seen != np.uint64(2**64 - 1))]
        return out


class Model:
    """Frozen code lengths. ``cost[k]`` has bits of the last byte of each known string of k + 1 bytes, ``escape[k]`` of leaving a context of k bytes, by language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        texts = {}
        for name in self.languages:
            parts = [np.frombuffer(t, np.uint8) for t in samples[name] if t]
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
            texts[name] = _padded(np.concatenate(parts) if parts else np.zeros(0, np.uint8), offsets)
        counts = []
        for n in range(1, ORDER + 2):
            found = {}
            for name, (data, at) in texts.items():
                keep = np.ones(max(len(data) - ORDER, 0), bool)
                for k in range(ORDER):  # strings that end in a row's padding
                    inner = at[1:-1] + k - ORDER
                    keep[inner[(inner >= 0) & (inner < len(keep))]] = False
                found[name] = np.unique(_grams(data, n)[keep], return_counts=True)
            counts.append(found)
        self.tables, self.cost, self.escape = [], [], []
        last_keys, last_cost = None, None
        for n in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counts[n - 1].values())]))
            parents = np.unique(keys >> np.uint64(8))
            cost, escape = np.zeros((len(keys), len(self.languages)), np.float32), np.zeros((len(parents), len(self.languages)), np.float32)
            for j, name in enumerate(self.languages):
                own, times = counts[n - 1][name]
                parent = np.searchsorted(parents, own >> np.uint64(8))
                total, distinct = np.bincount(parent, times, len(parents)), np.bincount(parent, minlength=len(parents))
                escape[:, j] = np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1))
                shorter = np.full(len(keys), 8.0) if n == 1 else last_cost[np.searchsorted(last_keys, keys & np.uint64((1 << 8 * (n - 1)) - 1)), j]
                cost[:, j] = escape[np.searchsorted(parents, keys >> np.uint64(8)), j] + shorter
                cost[np.searchsorted(keys, own), j] = np.log2((total + distinct)[parent] / times)
            self.tables.append((Table(keys), Table(parents)))
            self.cost.append(cost)
            self.escape.append(escape)
            last_keys, last_cost = keys, cost

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length of each row under each language."""
        rows, names = len(offsets) - 1, len(self.languages)
        padded, at = _padded(data, offsets)
        if len(data) == 0:
            return np.zeros((rows, names))
        position = np.arange(len(data)) + np.repeat(ORDER * np.arange(rows), np.diff(offsets))  # into strings that end from ORDER on
        cost = np.zeros((len(data), names), np.float32)
        left, where = np.arange(len(data)), position
        for n in range(ORDER + 1, 0, -1):
            keys = _grams(padded, n)[where] if n == ORDER + 1 else keys & np.uint64((1 << 8 * n) - 1)
            full, context = self.tables[n - 1]
            row = full.find(keys)
            known = row >= 0
            if n == ORDER + 1 and known.all():
                cost = self.cost[n - 1][row]
            else:
                cost[left[known]] += self.cost[n - 1][row[known]]
            left, keys = left[~known], keys[~known]
            if len(left) == 0:
                break
            above = context.find(keys >> np.uint64(8))
            cost[left] += np.where((above >= 0)[:, None], self.escape[n - 1][np.maximum(above, 0)], np.float32(0))
        cost[left] += np.float32(8.0)
        out = np.zeros((rows, names))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        out[filled] = np.add.reduceat(cost, offsets[filled], axis=0, dtype=np.float64)
        return out


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ends = np.r_[0, np.cumsum(_LETTER[data])]
    out = ends[offsets[1:]] > ends[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


FOUND = "lang_pred string, score double, bits_per_byte double"


def _predict(texts: pa.Array, model: Model) -> pa.Array:
    """A struct of FOUND for each text."""
    names = pa.array([*model.languages, "und"], pa.string())
    best, score, rate = (np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts)))
    for first, last, data, offsets in chunks(texts):
        letters = _has_letter(data, offsets) & (len(model.languages) > 0)
        if letters.any():
            bits = model.bits(data, offsets)
            least, at = bits.min(axis=1), np.arange(first, last)[letters]
            best[at] = bits.argmin(axis=1)[letters]
            score[at] = (1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1))[letters]
            rate[at] = (least / np.maximum(np.diff(offsets), 1))[letters]
    return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the languages of the labelled documents that are not held out, from a bounded sample.

    Three narrow reads, whatever the number of languages: the languages with about how many documents
    each has; documents whose hash is low enough that several times the sample is left, of which the
    lowest are taken; and the texts of those.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(F.broadcast(cut(counts)), "lang")
    low = ids.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < 8.0 * sample_docs / F.col("n")).select("lang", "h", "doc_id").distinct()
    few = cut(low.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("at") <= sample_docs).select("lang", "doc_id"))
    # one text of each document of the sample: what goes to the driver is bounded by both bounds for each language
    texts = labelled.select("doc_id", "lang", F.encode("text", "UTF-8").alias("text")).join(F.broadcast(few), ["doc_id", "lang"])
    texts = texts.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, sample_bytes)).alias("text")).orderBy("lang", "doc_id").collect()
    samples: dict[str, list[bytes]] = {}
    for r in texts:
        samples.setdefault(r["lang"], []).append(bytes(r["text"] or b""))
    return Model(samples)


def predicted(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The documents with a struct ``name`` of FOUND: the prediction of every row, from its text alone. Only texts go to Python, and only predictions come back."""

    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(_predict(part, model) for part in parts)

    predict.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(predict, f"{FOUND}").asNondeterministic()  # so that it runs once a row
    return docs.withColumn(name, found(F.col("text")))


def of_known_language(docs: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """The documents with their own columns, without those of no language that the model knows."""
    name = free_name(docs)
    kept = predicted(docs, learn(docs), name).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.bits_per_byte") <= max_bits))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    found = predicted(docs.select("doc_id", "text"), learn(docs), "found")  # nothing else can reach a prediction
    return found.select("doc_id", held_out().alias("held_out"), "found.*")
