import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline as C
from helpers import awkward, docs, empty
from paperloom.llm import language_id, mixing
from test_packing import check


def run(spark, frame):
    seen = []
    for name, stage in C.STAGES:
        before = frame
        frame = stage(spark, frame, None)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        seen.append((name, before, frame))
    return seen


def test_stages_on_the_smallest_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = run(spark, docs)
    assert len(C.STAGES) == 5
    for _, _, after in seen[:-1]:
        assert after.columns == docs.columns
    counts = [docs.count(), *(after.count() for _, _, after in seen)]
    assert counts[1] >= 0.97 * counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    packed = seen[-1][2]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    whole = C.run(spark, sf_dir)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_awkward_and_empty_tables(spark):
    for frame in (awkward(spark), empty(spark)):
        for _, _, after in run(spark, frame)[:-1]:
            assert after.columns == frame.columns


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_windows(texts):
    """Words that are left of each text: those under no window of 13 words that a smaller document has too."""
    first = {}
    for d, t in sorted(texts):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, t in texts:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_each_stage_equals_brute_force(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, start, known), (_, _, single), (_, _, short), (_, _, mix), (_, _, packed) = run(spark, frame)
    model, keep = language_id.learn(start), set()
    for r in start.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        if any(c.isalpha() for c in r.text or "") and model.bits(data, np.array([0, len(data)])).min() <= language_id.MAX_BITS * len(data):
            keep.add(r.doc_id)
    assert {r.doc_id for r in known.collect()} == keep
    assert {r.doc_id for r in single.collect()} == survivors([(r.doc_id, r.text) for r in known.collect()])
    left = without_windows([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id: words(r.text) for r in short.collect()} == {d: w for d, w in left.items() if w}
    rows = {r.doc_id: r for r in mixing.op7(short).collect()}
    copies = Counter(r.doc_id for r in mix.collect())
    for d, r in rows.items():
        rate = r.target / r.source_size if r.source_size else 0
        assert copies[d] in (int(rate), int(rate) + 1) and copies[d] * r.size == r.taken and copies[d] <= 2
    assert set(copies) <= set(rows)
    check([(r.doc_id, r.text) for r in mix.collect()], packed.collect(), 4096)


def survivors(texts):
    """Smallest id of each component of pairs at 5-word shingles and 0.8, by brute force."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for d, w in ((d, words(t.translate(lower))) for d, t in texts)}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return set(label.values())


def test_near_duplicates_go_at_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{k}x{j}" for j in range(rng.choice([4, 30, 100, 100, 200]))]
        for changes in (0, 1, 2, 3, 5, 9):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = f"new{len(rows)}x{at}"
            rows.append((len(rows) + 1, " ".join(copy)))
    # two isolated changes in 100 words: 86 of 106 five-word shingles, 89 of 105 four-word shingles
    words = [f"u{j}" for j in range(100)]
    rows += [(1001, " ".join(words)), (1002, " ".join("new" + w if w in ("u30", "u60") else w for w in words))]
    left = {r.doc_id for r in C.one_of_each_group(spark, docs(spark, rows), None).collect()}
    assert 1001 in left and 1002 not in left
    assert left == survivors(rows)
