import math
from collections import Counter, defaultdict

import numpy as np

from helpers import awkward, docs, empty
from paperloom.llm import language_id as L
from paperloom.llm.common import table


def brute_bits(samples: list[bytes], text: bytes) -> float:
    """Code length by walking each context down, from dictionaries."""
    fold = lambda t: L._padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
    counts = defaultdict(Counter)
    for s in samples:
        s = fold(s)
        for i in range(L.ORDER, len(s)):
            for k in range(L.ORDER + 1):
                counts[s[i - k : i]][s[i]] += 1
    text, bits = fold(text), 0.0
    for i in range(L.ORDER, len(text)):
        for k in range(L.ORDER, -1, -1):
            own = counts.get(text[i - k : i])
            if own is None:
                continue
            total, distinct = sum(own.values()), len(own)
            if text[i] in own:
                bits -= math.log2(own[text[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"that cat"], "b": ["der hund saß auf dem Öl".encode(), b""]}
    model = L.Model(samples)
    texts = [b"the hat", "ÖLHund".encode(), b"", b"zzz qqq", b"t"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = model.bits(data, offsets)
    for k, text in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert math.isclose(got[k, j], brute_bits(samples[name], text), rel_tol=1e-5, abs_tol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = L.op1(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang == found.lang_pred).mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_defined_results(spark):
    found = {(r.doc_id, r.lang_pred) for r in L.op1(awkward(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= found
    assert L.op1(awkward(spark)).count() == 9
    assert L.op1(empty(spark)).count() == 0
    assert {r.lang_pred for r in L.op1(docs(spark, [(1, "some text"), (2, "more")])).collect()} == {"und"}  # nothing to learn from


def test_stage_keeps_columns_and_drops_rejected(spark):
    before = awkward(spark).unionByName(docs(spark, [(k, "one two three words", "en", "a") for k in range(20, 40)]))
    after = L.of_known_language(before)
    assert after.columns == before.columns
    assert {r.doc_id for r in after.collect()} > {5, 20, 39} and not {1, 2, 3, 8} & {r.doc_id for r in after.collect()}
