import uuid
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import awkward, docs, empty
from paperloom.llm import simple8b as C
from paperloom.llm.common import shared_dir


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=3000))
def test_round_trip(values):
    ids = np.array(values, np.uint64)
    words, offsets = C.encode(ids)
    assert (C.decode(words, offsets) == ids).all()
    got, lengths = C.from_file(C.to_file(ids, np.array([len(ids)])))
    assert (got == ids).all() and lengths.tolist() == [len(ids)]


def test_slices_and_blocks():
    ids = np.random.default_rng(3).integers(0, 50_257, C.SLICE + 5 * C.BLOCK + 17)
    data = C.to_file(ids, np.array([10, len(ids) - 10]))
    assert (C.from_file(data)[0] == ids).all() and len(data) < 3 * len(ids)
    assert len(C.encode(np.zeros(C.BLOCK, np.uint64))[0]) == 18  # 17 words of 60, one of 4
    words, offsets = C.encode(ids)
    block = C.decode(words[offsets[7] : offsets[8]], np.array([0]))  # any block alone
    assert (block == ids[7 * C.BLOCK : 8 * C.BLOCK]).all()


def expected(rows):
    whole, at, out = Tokenizer.from_file(C.tokenizer_path(C.TOKENIZER)), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [C.END], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_library(spark, monkeypatch):
    rows = [(k * 7 % 101, f"Text {k}, with words\n and  blanks " * (k % 9)) for k in range(101)]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.op10(docs(spark, rows)).collect())
    assert got == expected(rows)


def test_defined_results(spark):
    frame = awkward(spark)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.op10(frame).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in frame.collect()])
    assert C.op10(empty(spark)).count() == 0


def test_ids_come_back_from_files(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = C.write_tokens(docs(spark, [(2, "b b"), (1, "a")]), folder)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in C.read_tokens(spark, folder, manifest).collect()}
    whole = Tokenizer.from_file(C.tokenizer_path(C.TOKENIZER))
    assert got == {1: whole.encode("a").ids + [0], 2: whole.encode("b b").ids + [0]}


def test_tasks_of_a_worker_share_a_tokenizer():
    import pytest
    from paperloom.llm.encoding import Encoder
    from paperloom.llm.packing import TOKENIZER, tokenizer_path

    path = tokenizer_path(C.TOKENIZER)
    assert Encoder(path, False, 0).tokenizer is Encoder(path, False, 0).tokenizer
    damaged = Encoder(tokenizer_path(TOKENIZER), True, 2)
    before = str(damaged.tokenizer.normalizer)
    damaged.parts = None  # a task that fails half way leaves the tokenizer as it was
    with pytest.raises(TypeError):
        damaged._joined(["abc"])
    assert before != "None" and str(damaged.tokenizer.normalizer) == before
