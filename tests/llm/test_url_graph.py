import numpy as np

from paperloom.llm import url_graph as U


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def judged(spark, rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.op2(pages(spark, [(*r, "x", "y") for r in rows])).collect()}


def test_rules_and_parts(spark):
    got = judged(
        spark,
        [
            (1, "https://A.Example.ORG/en/12?q#f", None), (2, "http://example.org/es/x", ""), (3, "http://b.example.org", "z"), (4, "ftp://notexample.org/es/", ""),
            (5, "http://x.com/de/1", ""), (6, "http://x.com/fr/1", ""), (7, None, None), (8, "no scheme", ""), (9, "http://h.net#a/b", ""), (10, "http://q.com?x=/de/", ""), (11, "a://ÄB.net/p", ""),
        ],
    )
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[3] == ("b.example.org", "", None, "allow")
    assert got[4] == ("notexample.org", "/es/", "org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[9][:2] == ("h.net", "") and got[10][:2] == ("q.com", "") and got[11][0] == "Äb.net"


def test_spread_equals_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3)]
    seeds = {"a": 0.75, "d": 0.25}
    score = {k: 0.15 * v for k, v in seeds.items()}
    out = {s: sum(n for x, _, n in edges if x == s) for s, _, _ in edges}
    for _ in range(U.ROUNDS):
        new = {k: 0.15 * v for k, v in seeds.items()}
        for s, t, n in edges:
            if s in score:
                new[t] = new.get(t, 0) + 0.85 * n / out[s] * score[s]
        score = new
    got = U.spread(spark.createDataFrame(list(seeds.items()), "host string, mass double"), spark.createDataFrame(edges, "src string, dst string, links long")).collect()
    assert {r.host: round(r.score, 12) for r in got} == {k: round(v, 12) for k, v in score.items()}


def test_distrust_flows_against_links(spark):
    link = '<a class="x" href="http://bad.com/de/9">bad</a>'
    got = judged(spark, [(1, "http://bad.com/de/1", ""), (2, "http://feeds-bad.net/en/1", link), (3, "http://fine.net/en/1", '<a href="/x">x</a>'), (4, "http://bad.com/en/1", "")])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_empty_and_repeated(spark):
    assert judged(spark, [(1, "http://x.net/", ""), (1, "http://x.net/", "")]) == {1: ("x.net", "/", None, "allow")}
    assert U.op2(pages(spark, [(1, "x", "y", "", "")]).where("false")).count() == 0


def to(*hosts):
    return "".join(f'<a href="http://{h}/de/1">x</a>' for h in hosts)


def test_distrust_reaches_every_host_of_a_chain(spark):
    rows = [(0, "http://bad.com/de/1", "")] + [(k, f"http://h{k}.net/en/1", to(f"h{k - 1}.net" if k > 1 else "bad.com")) for k in range(1, 15)]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {k: "block" for k in range(15)}


def test_settled_scores_equal_the_exact_solution(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3)] + [(f"e{k}", f"e{k + 1}", 1) for k in range(11)] + [("c", "e0", 1)]
    seeds, hosts = {"a": 0.75, "d": 0.25}, sorted({h for s, t, _ in edges for h in (s, t)})
    flow = np.zeros((len(hosts), len(hosts)))
    for s, t, n in edges:
        flow[hosts.index(t), hosts.index(s)] = n / sum(m for x, _, m in edges if x == s)
    exact = np.linalg.solve(np.eye(len(hosts)) - 0.85 * flow, [0.15 * seeds.get(h, 0.0) for h in hosts])
    got = U.spread(spark.createDataFrame(list(seeds.items()), "host string, mass double"), spark.createDataFrame(edges, "src string, dst string, links long"), rounds=None).collect()
    assert len(got) == len(hosts)
    assert all(abs(r.score / exact[hosts.index(r.host)] - 1) < 1e-7 for r in got)
