import random
import re

import pytest

from helpers import awkward, docs, empty
from paperloom.llm import jaccard_join as J
from paperloom.llm.components import components


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.op6(frame).collect()}


def corpus(seed):
    r = random.Random(seed)
    rows, d = [], 0
    shared = [f"s{i}" for i in range(50)]
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(r.choice([8, 30, 60, 150]))]
        for _ in range(r.choice([3, 12, 30])):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            if r.random() < 0.2:
                w = w[: int(len(w) * r.uniform(0.8, 1))]
            rows.append((d, " ".join(w)))
            d += 1
    for _ in range(25):  # a passage that many documents share
        rows.append((d, " ".join(shared + [f"o{d}x{i}" for i in range(r.randint(2, 60))])))
        d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(900, "one TWO three"), (901, "ONE two three"), (902, "one two"), (903, rows[0][1].upper())]
    assert got(docs(spark, rows)) == brute(rows)


@pytest.mark.parametrize("block, held", [(1024, 1 << 18), (3, 1)])
def test_any_threshold_for_frequent_tokens_and_any_block_gives_the_same_links(spark, monkeypatch, block, held):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HELD", held)
    rows = corpus(7)
    expected = {d: c for d, (_, c) in brute(rows).items()}
    for rare, combine in ((1, 2), (3, 3), (10**6, 2)):
        classes, labels = J.jaccard_links(docs(spark, rows), rare=rare, combine=combine)
        by = {r.id: r.label for r in labels.collect()}
        assert {r.doc_id: by.get(r.rep, r.rep) for r in classes.collect()} == expected


def test_defined_results(spark):
    found = J.op6(awkward(spark)).collect()
    assert len(found) == 9
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (1, 5) and by[7][1] == 4 and by[None] == (3, None)
    assert J.op6(empty(spark)).count() == 0


def test_stage_keeps_one_of_each(spark):
    before = awkward(spark)
    after = J.one_of_each(before)
    assert after.columns == before.columns
    assert sorted((r.doc_id for r in after.collect()), key=str) == [1, 2, 3, 4, 5, 5, 8, None]


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 102), (102, 101)], "a long, b long")
    assert {r.id: r.label for r in components(path).collect()} == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
