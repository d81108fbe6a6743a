"""Token ids of whole texts by the tokenizers library, which sees each distinct piece of a step once.

A text is cut only where the tokenizer's own pre-tokenizer always cuts: before each run of blanks or
line ends, and between a run of Latin letters and the punctuation that ends a word. So the ids are
those of the whole text. Distinct runs of letters go to the library many at a time, as one text. Texts
with anything that makes the cuts unsure (rare white space, a special token's string) go to it whole.
Cutting, finding distinct pieces and putting ids together are Arrow and numpy calls over a step of
texts. From step to step only short parts are remembered, and about REMEMBERED of them, so memory
doesn't follow the data.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import chunks

#: Bytes of texts that are encoded together; parts that the library gets at once; parts after which all are forgotten; bytes of a part that is remembered.
STEP, AT_ONCE, REMEMBERED, LONGEST = 2 << 20, 4_000, 300_000, 64
#: Characters that the library gets at once, or one text: its answers take a hundred bytes an id.
AT_ONCE_CHARS = 1 << 18
#: Texts that go to the library whole: rare white space, and what looks like a special token.
_WHOLE = r"<\||[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Punctuation that may end a word.
_TAIL = ".,;:!?%#&*$|\"()"
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    place = np.repeat(first - (ends - size), size)
    place += np.arange(total)
    return values[place]


def _loaded(path: str, drops_space: bool) -> tuple:
    """(tokenizer, ids that part the runs of letters of one text), loaded once a Python worker.

    They are kept at the library's own module: this one travels by value, so each task has a new one. Loading
    anew in each task costs 0.4 seconds, and scattered memory that doesn't go back to the system.
    """
    import tokenizers

    file = os.stat(path)
    key, kept = (path, file.st_mtime_ns, file.st_size, drops_space), tokenizers.__dict__.setdefault("_paperloom_loaded", {})
    if key not in kept:
        kept.clear()
        tokenizer = tokenizers.Tokenizer.from_file(path)
        names = (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))
        # ids that end a word, or that begin with a blank
        kept[key] = tokenizer, np.fromiter((x.endswith("</w>") if drops_space else x.startswith("Ġ") for x in names), bool)
    return kept[key]


class Encoder:
    """Encodes arrays of texts to one array of ids and the number of ids of each text."""

    def __init__(self, path: str, drops_space: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer, self.parts = _loaded(path, drops_space)
        self.end, self.drops_space = end, drops_space
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of texts that the library gets one by one."""
        flat, sizes, k = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while k < len(texts):
            first, held = k, 0
            while k < len(texts) and k - first < AT_ONCE and held < AT_ONCE_CHARS:
                held += len(texts[k])
                k += 1
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[first:k], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _joined(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, each after a blank unless blanks are dropped, as one text at a time."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        normalizer = self.tokenizer.normalizer
        self.tokenizer.normalizer = None  # runs are lower case already where it would make them so, and nothing else in them changes
        try:
            for k in range(0, len(runs), AT_ONCE):
                some = runs[k : k + AT_ONCE]
                ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.drops_space else "").join(some)], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(self.parts[ids])
                edges = np.r_[0, marks + 1] if self.drops_space else np.r_[marks, len(ids)]
                ids, size = (ids, np.diff(edges)) if len(edges) == len(some) + 1 else self._each(some)
                flat.append(ids)
                sizes.append(size)
        finally:
            self.tokenizer.normalizer = normalizer  # the tokenizer outlives the task, whatever becomes of that
        return np.concatenate(flat), np.concatenate(sizes)

    def _remembered(self, parts: list[str], encode) -> np.ndarray:
        """Numbers of distinct parts; ``encode`` gets the new ones."""
        new = [p for p in parts if p not in self.codes]
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
        ids, size = encode(new)
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        return np.fromiter(map(self.codes.__getitem__, parts), np.int64, len(parts))

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each distinct piece begin, how many it has). A piece has two parts: run and tail, or itself and nothing."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        bare = pc.ascii_ltrim(pieces, characters=" \n") if self.drops_space else pieces
        run = pc.ascii_rtrim(bare, characters=_TAIL)
        split = pc.match_substring_regex(run, f"^{'' if self.drops_space else ' '}{_LETTERS}$").to_numpy(zero_copy_only=False)
        long = ~split & (pc.binary_length(pieces).to_numpy() > LONGEST)
        mine, short = pa.array(split), ~split & ~long
        run, bare = run.filter(mine), bare.filter(mine)
        tail = _after(bare, pc.binary_length(run).to_numpy()).dictionary_encode()
        runs = (pc.utf8_lower(run) if self.drops_space else run).dictionary_encode()
        code = np.zeros((len(pieces), 2), np.int64)
        code[:, 1] = self._remembered([""], self._each)
        code[split, 0] = self._remembered(runs.dictionary.to_pylist(), self._joined)[runs.indices.to_numpy()]
        code[split, 1] = self._remembered(tail.dictionary.to_pylist(), self._each)[tail.indices.to_numpy()]
        code[short, 0] = self._remembered(pieces.filter(pa.array(short)).to_pylist(), self._each)
        code[long, 0] = len(self.size) + np.arange(long.sum())
        long_ids, long_size = self._each(pieces.filter(pa.array(long)).to_pylist())
        ids, size = np.concatenate([self.ids, long_ids]), np.concatenate([self.size, long_size])
        each = size[code]
        total = each.sum(axis=1)
        return _gather(ids, (np.cumsum(size) - size)[code.ravel()], each.ravel()), np.cumsum(total) - total, total

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of one step, the end id after each."""
        rows = len(offsets) - 1
        blank = (data == 0x20) | (data == 0x0A)
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        texts = _strings(offsets, data)
        whole = pc.match_substring(texts, "<|") if self.drops_space else pc.match_substring_regex(texts, _WHOLE)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            cut[offsets[k] : offsets[k + 1]] = False
        filled = np.flatnonzero(np.diff(offsets) > 0)
        cut[offsets[filled]] = True
        at = np.flatnonzero(cut)
        pieces = _strings(np.r_[at, len(data)], data).dictionary_encode()
        ids, first, size = self._known(pieces.dictionary) if len(at) else (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2)
        # one more piece after each text: the end id
        count = np.diff(np.searchsorted(at, offsets))
        code = np.full(len(at) + rows, len(size), np.int64)
        code[np.arange(len(at)) + np.repeat(np.arange(rows), count)] = pieces.indices.to_numpy()
        ids, first, size = np.r_[ids, np.uint32(self.end)], np.r_[first, len(ids)], np.r_[size, 1]
        each = size[code]
        ends = np.r_[0, np.cumsum(each)][np.cumsum(count + 1)]
        return _gather(ids, first[code], each).astype(np.uint32), np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array, step: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, how many of each row) of each step; null texts are empty."""
        for first, last, data, offsets in chunks(texts, step or STEP):
            yield first, last, *self._step(data, offsets)


def _after(texts: pa.Array, at: np.ndarray) -> pa.Array:
    """What follows the first ``at`` bytes of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, rest = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.diff(ends) - at
    return _strings(np.r_[0, np.cumsum(rest)], _gather(data, ends[:-1] + at, rest))
