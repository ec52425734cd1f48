"""Best paths of each start against a full search in plain Python."""

from __future__ import annotations

import random

from tidegrid.operators import graph, search

RANK = {"UNKNOWN": 0, "AMBIGUOUS": 1, "INFERRED": 2, "EXACT": 3}


def brute(nodes, edges, start, targets, depth):
    kind = {n: (t, s) for n, t, s in nodes}
    around = {}
    for e, a, b, _, c in edges:
        around.setdefault(a, []).append((e, b, c))
        if a != b:
            around.setdefault(b, []).append((e, a, c))
    out, stack = [], [([start], [], [])]
    while stack:
        path, es, cs = stack.pop()
        if es and kind[path[-1]][0] in targets:
            out.append((-min(RANK[c] for c in cs), len(es), ">".join(es), path[-1], any(kind[n][1] == "external" for n in path) or "UNKNOWN" in cs))
        elif len(es) < depth:
            stack += [([*path, b], [*es, e], [*cs, c]) for e, b, c in around.get(path[-1], []) if b not in path]
    return sorted(out)


def made(spark, seed, n=14, m=26):
    r = random.Random(seed)
    nodes = [(f"n{i}", r.choice(["A", "B", "C", "T"]) if i else "A", r.choice(["active", "active", "external"])) for i in range(n)]
    edges = [(f"e{r.choice(['', 'x'])}{j}", f"n{r.randrange(n)}", f"n{r.randrange(n)}", "GLOBAL", r.choice(list(RANK))) for j in range(m)]
    return nodes, edges, spark.createDataFrame(nodes, "id string, type string, status string"), spark.createDataFrame([(e, a, b, "X", v, c) for e, a, b, v, c in edges], "id string, src string, dst string, type string, env string, confidence string")


def test_first_paths_of_every_start(spark):
    """The same paths in the same order as the full search, in graphs with cycles, loops, parallel edges, and starts that are targets."""
    for seed, most in ((1, 5), (4, 1000)):
        nodes, edges, n, e = made(spark, seed)
        found = search.best_paths(n, graph.adjacency(e), n, ["T"], depth=5, most=most).collect()
        got = {}
        for r in found:
            got.setdefault(r.start_id, []).append((-RANK[r.confidence], r.length, ">".join(r.edges), r.end_id, r.unresolved, r.truncated))
        for start, _, _ in nodes:
            want = brute(nodes, edges, start, {"T"}, 5)
            assert sorted(got.get(start, [])) == [(*w, len(want) > most) for w in want[:most]], (seed, start)


def test_a_hub_costs_its_first_paths_only(spark, monkeypatch):
    """A start with thousands of equal ways on keeps as many prefixes as paths are asked for."""
    wide = 3000
    nodes = [("s", "A", "active"), *((f"m{i:05}", "B", "active") for i in range(wide)), ("t", "T", "active"), ("u", "T", "active")]
    edges = [(f"a{i:05}", "s", f"m{i:05}", "X", "GLOBAL", "EXACT") for i in range(wide)] + [(f"b{i:05}", f"m{i:05}", "t" if i % 2 else "u", "X", "GLOBAL", "EXACT") for i in range(wide)]
    sizes = []
    plain = search.settle
    monkeypatch.setattr(search, "settle", lambda df, name="graph": sizes.append((name, (out := plain(df, name)).count())) or out)
    n, e = spark.createDataFrame(nodes, "id string, type string, status string"), spark.createDataFrame(edges, "id string, src string, dst string, type string, env string, confidence string")
    rows = search.best_paths(n, graph.adjacency(e), n.where("id = 's'"), ["T"], most=10).collect()
    assert sorted(r.edges[0] for r in rows) == [f"a{i:05}" for i in range(10)] and all(r.truncated for r in rows)
    assert [k for name, k in sizes if name == "kept"] == [11, 11]


def test_state_budget_is_told(spark):
    """Beyond the budget of states the search goes on with the most promising ones and says so; one that needs less is exact."""
    nodes, edges, n, e = made(spark, 7, n=12, m=34)
    start = n.where("id = 'n0'")
    want = brute(nodes, edges, "n0", {"T"}, 6)
    full = search.best_paths(n, graph.adjacency(e), start, ["T"], depth=6, most=5000).collect()
    assert len(full) == len(want) and not any(r.truncated for r in full)
    few = search.best_paths(n, graph.adjacency(e), start, ["T"], depth=6, most=5000, states=3).collect()
    assert few and len(few) < len(want) and all(r.truncated for r in few)
    assert {tuple(r.edges) for r in few} <= {tuple(r.edges) for r in full}


def test_nothing_to_reach(spark):
    nodes, _, n, e = made(spark, 3)
    assert search.best_paths(n, graph.adjacency(e), n, ["Z"]).collect() == []
    assert search.best_paths(n, graph.adjacency(e.limit(0)), n, ["T"]).collect() == []
    assert search.best_paths(n, graph.adjacency(e), n.limit(0), ["T"]).collect() == []
