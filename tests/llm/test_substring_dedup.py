import hashlib
import random

import pytest

from helpers import LONG, awkward, docs, empty
from paperloom.llm import substring_dedup as S


def brute(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - S.WINDOW + 1):
                key = tuple(w[i : i + S.WINDOW])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - S.WINDOW + 1):
                if first[tuple(w[i : i + S.WINDOW])] < d:
                    gone.update(range(i, i + S.WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.op3(frame).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(r.randint(10, 40))] for k in range(6)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [f"u{r.randint(0, 40)}" for _ in range(r.randint(0, 20))]
            p = r.choice(passages)
            a = r.randint(0, 5)
            w += p[a:]
        rows.append((d, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "x " * 60), (203, "x " * 40)]
    assert got(docs(spark, rows)) == brute(rows)


def test_cover_finds_every_alignment():
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any(S._IN_COVER[(a + k) % S.PERIOD] and S._IN_COVER[(b + k) % S.PERIOD] for k in range(S.PERIOD))
    assert S.ANCHOR + S.PERIOD - 1 == S.WINDOW


def test_defined_results(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()]
    assert got(awkward(spark)) == brute(rows)
    assert {r.doc_id: r.n_removed for r in S.op3(awkward(spark)).collect()}[7] == len(LONG.split())
    assert S.op3(empty(spark)).count() == 0


def test_stage_keeps_columns_and_other_texts(spark):
    before = awkward(spark)
    after = S.remove_repeats(before)
    assert after.columns == before.columns and after.count() == 9
    texts = {r.doc_id: r.text for r in after.collect()}
    assert texts[7] == "" and texts[4] == LONG and texts[3] == " \n\t " and texts[1] is None


def test_groups_give_their_memory_back(spark, monkeypatch):
    from pyspark.sql import functions as F

    from paperloom.llm import common

    table = spark.range(20).select((F.col("id") % 5).alias("bucket"), "id")
    got = common.map_groups(table, "bucket", lambda g: g.select(["id"]), "id long")
    assert sorted(r.id for r in got.collect()) == list(range(20))
    plain, seen = common.release, []
    monkeypatch.setattr(common, "release", lambda: seen.append(plain()))
    held = []
    monkeypatch.setattr(type(table), "groupBy", lambda self, key: type("G", (), {"applyInArrow": lambda _, f, schema: held.append(f)})())
    common.map_groups(table, "bucket", lambda g: g, "id long")
    assert held[0]("a group") == "a group" and len(seen) == 1
