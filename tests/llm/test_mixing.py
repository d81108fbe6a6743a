from helpers import awkward, docs, empty
from paperloom.llm import mixing as M


def water(sizes):
    """Excess over the caps reshared by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    rest, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    return target


def test_targets_and_taken(spark):
    rows = [(k, "w " * (k % 40 + 1), "en", s) for k in range(900) for s in [("a", "b", "c", "d", None, "é", "z")[k % 7 if k % 3 else 0]]]
    got = M.op7(docs(spark, rows)).toPandas()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected = water(sizes)
    for source, group in got.groupby(got.source.fillna("-"), dropna=False):
        key = None if source == "-" else source
        assert abs(group.target.iloc[0] - expected[key]) < 1e-6 * max(1, expected[key])
        assert abs(group.taken.sum() - expected[key]) < 0.03 * expected[key] + 40
    assert (got.taken <= 2 * got["size"]).all()
    again = M.op7(docs(spark, rows, 5)).toPandas()
    key = ["doc_id", "taken", "target"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_defined_results(spark):
    got = M.op7(awkward(spark)).collect()
    assert len(got) == 9 and all(r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert M.op7(empty(spark)).count() == 0
    assert M.op7(docs(spark, [(1, None), (2, "")])).count() == 2  # no words at all


def test_stage_repeats_rows_with_their_columns(spark):
    before = docs(spark, [(k, f"word{k} " * 20, "en", "ab"[k % 2]) for k in range(200)])
    after, plan = M.mix(before), {r.doc_id: r.copies for r in M.op7(before).collect()}
    assert after.columns == before.columns
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}
