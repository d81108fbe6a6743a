import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import awkward, docs, empty
from paperloom.llm import packing as P
from paperloom.llm.encoding import Encoder

TRICKY = ["it's don't 'S I'LL  two  spaces\t tab\u2003em x\n\n\ny \n z  ", "<|endoftext|> a", "", None, " lead", "trail ", "Éá é İı ß²½ Ⅷ _a 12ab3", "a\x1c b\x85c\u00a0d", "word.\nThe (x) \"y\" a|b", "日本語 🙂🙂 a🙂", "\n\n", "ſ K Å"]


def encoded(encoder, texts, step=None):
    out = []
    for _, _, ids, size in encoder.encode(pa.array(texts, pa.string()), step):
        at = np.r_[0, np.cumsum(size)]
        out += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    return out


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, drops, monkeypatch):
    from paperloom.llm import encoding

    whole = Tokenizer.from_file(P.tokenizer_path(name))
    texts = TRICKY + [f"Same words again and AGAIN, with new{chr(97 + k)} {chr(98 + k) * 3}!! " * 3 for k in range(12)]
    expected = [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
    assert encoded(Encoder(P.tokenizer_path(name), drops, 7), texts) == expected
    monkeypatch.setattr(encoding, "AT_ONCE", 3)
    monkeypatch.setattr(encoding, "REMEMBERED", 5)
    encoder = Encoder(P.tokenizer_path(name), drops, 7)
    for step in (1, 40):  # what is remembered and forgotten changes nothing
        assert encoded(encoder, texts, step) == expected
    assert encoded(encoder, ["", None]) == [[7], [7]] and encoded(encoder, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abEé'’. ,\n\t\u00a0\u0301\u0338<|>9_日ſ\x1c"), max_size=30), max_size=6))
def test_any_texts(texts):
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        if name not in KEPT:
            KEPT[name] = Encoder(P.tokenizer_path(name), drops, 7), Tokenizer.from_file(P.tokenizer_path(name))
        encoder, whole = KEPT[name]
        assert encoded(encoder, texts) == [whole.encode(t, add_special_tokens=False).ids + [7] for t in texts]


KEPT = {}


def check(rows, got, length):
    whole = Tokenizer.from_file(P.tokenizer_path(P.TOKENIZER))
    expected = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [P.END]) for _, t in rows)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.sequence_id * length + r.offset - r.start, []).append(r)  # the document's place in the stream
        sequences.setdefault(r.sequence_id, []).append(r)
    rebuilt = []
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own])
        assert len(ids) == own[0].doc_tokens and all(len(r.ids) == 4 * r.length for r in own)
        rebuilt.append(tuple(ids.tolist()))
    assert sorted(rebuilt) == expected
    last = max(sequences, default=0)
    for k, own in sequences.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.r_[0, np.cumsum([r.length for r in own])[:-1]].tolist()
        assert sum(r.length for r in own) == length or k == last


def test_every_id_in_one_piece(spark):
    rows = [(k, TRICKY[k % len(TRICKY)]) for k in range(40)] + [(99, "many words " * 300), (99, "many words " * 300)]
    for length in (64, 4096):
        check(rows, P.pack(docs(spark, rows), length=length).collect(), length)


def test_defined_results(spark):
    frame = awkward(spark)
    check([(r.doc_id, r.text) for r in frame.collect()], P.pack(frame).collect(), P.LENGTH)
    assert P.pack(empty(spark)).count() == 0
    row = P.op8(docs(spark, [(1, None)])).first()
    assert (row.start, row.length, row.doc_tokens, row.offset) == (0, 1, 1, 0) and row.ids_crc32 == zlib.crc32(np.array([P.END], "<u4").tobytes())
