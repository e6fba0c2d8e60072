import heapq
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import components as C
from lattica.operators import kernels as K
from lattica.operators import traverse as T
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources.templates import template


def build(spark, text, directed=True, extra=()):
    """'a>b:3 b>c' to a graph; weights default to 1."""
    edges = []
    for item in text.split():
        ends, _, w = item.partition(":")
        edges.append((*ends.split(">"), float(w or 1)))
    nodes = sorted({x for e in edges for x in e[:2]} | set(extra))
    return PropertyGraph.build(spark, nodes, edges, directed)


def ids(frame, order="id"):
    return [r.id for r in frame.orderBy(order).select("id").collect()]


def test_bfs_and_early_stop(spark):
    g = build(spark, "a>b a>c b>d")
    assert ids(T.bfs(g, "a"), "ord") == ["a", "b", "c", "d"]
    assert ids(T.bfs(g, "a", F.col("id") == "b"), "ord") == ["a", "b"]
    assert ids(T.bfs(g, "nowhere"), "ord") == []


def test_dfs_early_stop(spark):
    g = build(spark, "a>b b>c a>d d>e")
    assert ids(K.dfs(g, "a"), "ord") == ["a", "b", "c", "d", "e"]
    assert ids(K.dfs(g, "a", F.col("id").isin("c", "e")), "ord") == ["a", "b", "c"]
    assert ids(K.dfs(g, "a", F.col("id") == "none"), "ord") == ["a", "b", "c", "d", "e"]


def test_levels_and_slack_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "MERGE", 2)  # tables of levels are merged often
    rng = random.Random(4)
    arcs = {(f"n{a:02}", f"n{b:02}"): rng.randint(-2, 9) for a, b in (sorted(rng.sample(range(24), 2)) for _ in range(50))}
    g = build(spark, " ".join(f"{a}>{b}:{w}" for (a, b), w in arcs.items()), extra=("alone",))
    names = sorted({x for e in arcs for x in e})
    level, early = dict.fromkeys([*names, "alone"], 0), dict.fromkeys([*names, "alone"], 0)
    for a, b in sorted(arcs):  # sorted by start: all ways to a node are known before its own arcs
        level[b], early[b] = max(level[b], level[a] + 1), max(early[b], early[a] + arcs[a, b])
    late = dict.fromkeys(level, max(early.values()))
    for a, b in sorted(arcs, reverse=True):
        late[a] = min(late[a], late[b] - arcs[a, b])
    for small in (-1, 200_000):
        monkeypatch.setattr(T, "SMALL", small)
        assert {r.id: r.level for r in T.topological_levels(g).collect()} == level
        rows, length = T.critical_path(g)
        assert length == max(early.values()) and {r.id: (r.earliest, r.latest, r.critical) for r in rows.collect()} == {k: (early[k], late[k], early[k] == late[k]) for k in level}


@pytest.mark.parametrize(
    ("name", "start", "bfs", "dfs"),
    [
        ("knowledge", "cnn", "cnn dl nn ml transformers nlp rl stats pca regression", "cnn dl nn ml nlp transformers rl stats pca regression"),
        ("dependencies", "app", "app api web auth db router ui crypto logger config utils", "app api auth crypto logger db config web router utils ui"),
    ],
)
def test_orders_of_templates(spark, name, start, bfs, dfs):
    g = template(spark, name)
    assert ids(T.bfs(g, start), "ord") == bfs.split()
    assert ids(K.dfs(g, start), "ord") == dfs.split()


def test_topological_order_and_cycles(spark):
    assert ids(K.topological_sort(template(spark, "dependencies")), "ord") == "app api auth crypto db web router logger ui config utils".split()
    levels = {r.id: r.level for r in T.topological_levels(build(spark, "a>b a>c b>d c>d")).collect()}
    assert levels == {"a": 0, "b": 1, "c": 1, "d": 2}
    two = build(spark, "a>b b>a")
    for f in (K.topological_sort, T.topological_levels, T.critical_path):
        with pytest.raises(GraphError):
            f(two)
    assert K.cycle_path(build(spark, "a>b b>c c>a")) == ["b", "c", "a"]
    assert K.cycle_path(build(spark, "a>a")) == ["a", "a"]
    assert K.cycle_path(build(spark, "x>a a>b b>c c>d d>b")) == ["c", "d", "b"]
    assert not T.has_cycle(build(spark, "a>b")) and not T.has_cycle(build(spark, "a>b b>c", False))


def test_shortest_path(spark):
    g = build(spark, "a>b:1 b>d:2 a>c:1 c>d:1", extra=["z"])
    assert T.shortest_path(g, "a", "d") == (["a", "c", "d"], 2.0)
    assert T.shortest_path(g, "a", "a") == (["a"], 0.0)
    with pytest.raises(GraphError, match="no path"):
        T.shortest_path(g, "a", "z")
    with pytest.raises(GraphError, match="source"):
        T.shortest_path(g, "q", "a")
    with pytest.raises(GraphError, match="weights"):
        T.shortest_path(build(spark, "a>b:-1"), "a", "b")


def test_reachability(spark):
    g = build(spark, "a>b b>c a>d d>c")
    assert ids(T.ancestors(g, "c")) == ["a", "b", "d"]
    assert ids(T.descendants(g, "a")) == ["b", "c", "d"]
    ring = build(spark, "a>b b>a")
    assert ids(T.descendants(ring, "a")) == ["a", "b"]
    assert ids(T.descendants(build(spark, "a>b", False), "a")) == ["a", "b"]
    closed = T.transitive_closure(build(spark, "a>b b>c c>d")).edges
    assert {(r.src, r.dst, r.weight) for r in closed.collect()} == {(a, b, 1.0) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")}
    with pytest.raises(GraphError):
        T.transitive_closure(build(spark, "a>b", False))


def test_all_pairs(spark):
    pairs = T.all_pairs(build(spark, "a>b:1 b>c:2 a>c:10"))
    assert {(r.src, r.dst): r.dist for r in pairs.collect()} == {("a", "a"): 0, ("b", "b"): 0, ("c", "c"): 0, ("a", "b"): 1, ("b", "c"): 2, ("a", "c"): 3}
    assert T.reconstruct_path(pairs, "a", "c") == ["a", "b", "c"]
    for a, b, why in (("q", "a", "source"), ("a", "q", "destination"), ("c", "a", "no path")):
        with pytest.raises(GraphError, match=why):
            T.reconstruct_path(pairs, a, b)
    with pytest.raises(GraphError, match="negative"):
        T.all_pairs(build(spark, "a>b:1 b>a:-2"))


def test_critical_path(spark):
    rows, length = T.critical_path(build(spark, "a>b:3 a>c:2 b>d:1 c>d:4"))
    assert length == 6 and {r.id: r.slack for r in rows.collect()} == {"a": 0, "b": 2, "c": 0, "d": 0}
    rows, length = T.critical_path(template(spark, "orgchart"))
    assert length == 3 and {r.id for r in rows.collect() if r.critical} == {"ceo", "cto", "eng1", "dev1", "dev2"}


def test_simple_paths(spark):
    g = template(spark, "workflow")
    found = [r.path for r in T.simple_paths(g, "push", "deploy").collect()]
    assert found == [["push", *m, "staging", "deploy"] for m in (["build", "docker"], ["lint", "scan"], ["test", "coverage"])]
    assert [r.path for r in T.simple_paths(g, "push", "push").collect()] == [["push"]]
    assert T.simple_paths(g, "deploy", "push").collect() == []


def test_components(spark):
    g = build(spark, "a>b b>c c>a c>d")
    assert {r.id: r.component for r in C.strongly_connected(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    parts = C.connected(build(spark, "a>b c>d", False, ["z"])).collect()
    assert {r.id: r.component for r in parts} == {"a": "a", "b": "a", "c": "c", "d": "c", "z": "z"}


def test_spanning_forest(spark):
    rows = C.minimum_spanning_forest(build(spark, "a>b:1 b>c:2 a>c:3 a>a:0", False)).collect()
    assert [(r.src, r.dst, r.weight) for r in rows] == [("a", "b", 1.0), ("b", "c", 2.0)]
    with pytest.raises(GraphError):
        C.minimum_spanning_forest(build(spark, "a>b"))
    known = C.minimum_spanning_forest(template(spark, "knowledge")).collect()
    assert sorted(f"{r.src}-{r.dst}" for r in known) == "cnn-dl dl-nn ml-nlp ml-nn ml-rl ml-stats nlp-transformers pca-stats regression-stats".split()


def test_max_flow(spark):
    value, flow, cut = K.max_flow(build(spark, "s>a:10 s>b:5 a>t:5 b>t:10 a>b:3"), "s", "t")
    assert value == 13 and {(r.src, r.dst) for r in cut.collect()} == {("a", "b"), ("a", "t"), ("s", "b")}
    sums = {}
    for r in flow.collect():
        sums[r.src] = sums.get(r.src, 0) - r.flow
        sums[r.dst] = sums.get(r.dst, 0) + r.flow
    assert sums == {"s": -13, "t": 13, "a": 0, "b": 0}
    lone = PropertyGraph.build(spark, ["s", "t"])
    assert K.max_flow(lone, "s", "t")[0] == 0
    for args in (("s", "s"), ("x", "t"), ("s", "x")):
        with pytest.raises(GraphError):
            K.max_flow(lone, *args)


def test_against_plain_algorithms(spark):
    """Random graphs against heap, stack and matrix versions in plain Python."""
    rng = random.Random(5)
    for n, m in ((9, 16), (12, 40)):
        names = [f"n{i}" for i in range(n)]
        edges = {(rng.choice(names), rng.choice(names)): float(rng.randint(1, 9)) for _ in range(m)}
        g = PropertyGraph.build(spark, names, [(a, b, w) for (a, b), w in edges.items()]).materialize()
        out = {v: sorted(b for a, b in edges if a == v) for v in names}
        dist, heap = {}, [(0.0, "n0")]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in dist:
                dist[v] = d
                for w in out[v]:
                    heapq.heappush(heap, (d + edges[v, w], w))
        near = [sorted(map(str, T.distances(g, "n0").collect())) for T.SMALL in (-1, 200_000)]  # a loop of jobs, one task
        assert near[0] == near[1] and {r.id: r.dist for r in T.distances(g, "n0").collect()} == dist
        order, seen = ["n0"], {"n0"}
        for v in order:
            for w in out[v]:
                if w not in seen:
                    seen.add(w)
                    order.append(w)
        for T.SMALL in (-1, 200_000):
            assert ids(T.bfs(g, "n0"), "ord") == order
        reach = {(a, b) for a, b in edges}
        for k in names:
            reach |= {(i, j) for i in names for j in names if (i, k) in reach and (k, j) in reach}
        strong = {v: min([v, *(w for w in names if (v, w) in reach and (w, v) in reach)]) for v in names}
        assert {r.id: r.component for r in C.strongly_connected(g).collect()} == strong
