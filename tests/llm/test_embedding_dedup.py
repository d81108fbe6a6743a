import numpy as np

from paperloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, key long"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 0, 0) for i, v, label in rows], SCHEMA).repartition(partitions)


def brute(rows):
    unit = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(float)
        if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            unit[i] = (label, x / np.linalg.norm(x))
    ids = sorted(unit)
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98}
    label = {i: i for i, _, _ in rows}
    for _ in range(len(links) + 1):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


def clusters(seed, n=40, size=8, d=64):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = r.standard_normal(d)
        base /= np.linalg.norm(base)
        for k in range(size):
            rows.append((c * size + k, base + r.standard_normal(d) * r.choice([0.005, 0.012, 0.02]), c % 3))
    return rows


def test_recall_and_precision(spark):
    rows = clusters(1)
    got = {r.vec_id: r for r in E.op9(table(spark, rows)).collect()}
    links, _ = brute(rows)
    true = {i: sum(i in p for p in links) for i, _, _ in rows}
    assert all(got[i].n_links <= true[i] for i in true)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(true.values())


def test_blocks_give_the_same(spark, monkeypatch):
    rows = clusters(2, n=3, size=40)
    whole = {r.vec_id: (r.n_links, r.component_id) for r in E.op9(table(spark, rows)).collect()}
    monkeypatch.setattr(E, "BLOCK", 7)
    assert {r.vec_id: (r.n_links, r.component_id) for r in E.op9(table(spark, rows)).collect()} == whole


def test_defined_results(spark):
    v = list(np.ones(64))
    w = list(np.r_[np.ones(63), 1.01])
    rows = [(1, v, 0), (2, w, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 64, 0), (7, [float("nan")] * 64, 0), (8, [None] + v[1:], 0), (9, [], 0), (10, [1.0, 1.0], 0), (11, [float("inf")] + v[1:], 0), (12, v, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.op9(table(spark, rows)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert E.op9(table(spark, rows).where("false")).count() == 0
    twice = E.op9(table(spark, [(1, v, 0), (1, v, 0), (2, v, 0)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_rotations_are_orthogonal():
    x = np.random.default_rng(5).standard_normal((500, 16))
    for turn in E.learn(x / np.linalg.norm(x, axis=1, keepdims=True)):
        assert np.allclose(turn @ turn.T, np.eye(16))
