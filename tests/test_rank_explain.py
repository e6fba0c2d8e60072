import pytest

from lattica.operators import explain as E
from lattica.operators import rank as R
from lattica.operators.compare import diff
from lattica.operators.components import validate
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources.templates import template
from tests.test_traverse import build


def scores(frame):
    return {r.id: round(r.score, 6) for r in frame.collect()}


def test_degree_closeness_betweenness(spark):
    assert scores(R.degree_centrality(build(spark, "a>b a>c"))) == {"a": 1, "b": 0, "c": 0}
    assert scores(R.degree_centrality(build(spark, "a>b a>c", False))) == {"a": 1, "b": 0.5, "c": 0.5}
    line = build(spark, "a>b b>c")
    assert scores(R.closeness(line)) == {"a": 0.666667, "b": 1, "c": 0}
    assert scores(R.betweenness(line)) == {"a": 0, "b": 1, "c": 0}
    assert scores(R.betweenness(build(spark, "a>b a>c a>d", False))) == {"a": 3, "b": 0, "c": 0, "d": 0}
    known = scores(R.betweenness(template(spark, "knowledge")))
    assert known["ml"] == 21.5 and known["nn"] == 15.333333 and known["transformers"] == 3.5


def test_pagerank(spark):
    frame, iterations, converged = R.pagerank(build(spark, "a>b b>c c>a c>d"))
    assert scores(frame) == {"a": 0.213762, "b": 0.264622, "c": 0.307853, "d": 0.213762} and iterations == 30 and converged
    frame, _, converged = R.pagerank(build(spark, "a>b"))
    two = scores(frame)
    assert converged and two["b"] > two["a"]
    assert R.pagerank(PropertyGraph.empty(spark))[1:] == (0, True)


def test_analytics_and_summary(spark):
    row = R.analytics(build(spark, "a>b b>c c>d a>c")).first()
    assert (row.node_count, row.edge_count, round(row.density, 4), row.avg_degree, row.max_out_degree, row.components, row.diameter) == (4, 4, 0.3333, 1.0, 2, 1, 2)
    apart = R.analytics(build(spark, "a>b", False, ["c", "d"])).first()
    assert (apart.diameter, apart.components) == (-1, 3)
    none = R.analytics(PropertyGraph.empty(spark)).first()
    assert (none.node_count, none.components, none.diameter) == (0, 0, -1)
    assert R.analytics(PropertyGraph.build(spark, ["a"])).first().diameter == 0
    info = R.summary(template(spark, "taskplan"), "tp")
    assert info["status_counts"] == {"done": 3, "running": 1, "ready": 1, "pending": 3} and info["diameter"] == 6 and info["roots"] == ["analyze"]


def test_explain(spark):
    g = build(spark, "a>b:1 b>c:2")
    path = E.explain_path(g, "a", "c")
    assert path["path_length"] == 2 and path["total_weight"] == 3 and "2 hop(s)" in path["explanation"] and path["steps"][1] == "Step 2: 'b' -> 'c' (weight: 2.00)"
    part = E.explain_component(build(spark, "a>b b>c", False, ["d"]), "b")
    assert part["component_size"] == 3 and "connected component #1" in part["explanation"] and part["connections"] == ["'b' is directly connected to 'a'", "'b' is directly connected to 'c'"]
    ring = E.explain_component(build(spark, "a>b b>c c>a"), "a")
    assert "strongly connected component" in ring["explanation"] and ring["connections"][1] == "'a' receives an edge from 'c'"
    top = E.explain_centrality(build(spark, "a>b a>c"), "a")
    assert top["rank"] == 1 and "#1 out of 3" in top["explanation"] and top["factors"] == ["Out-degree: 2", "In-degree: 0", "Neighbor count: 2", "Connected to: b, c"]
    wide = E.explain_centrality(build(spark, "a>b a>c a>d a>e a>f a>g", False), "a")
    assert wide["factors"][-1] == "Connected to: b, c, d, e, f, ... and 1 more"
    for f in (E.explain_component, E.explain_centrality):
        with pytest.raises(GraphError):
            f(g, "nowhere")


def test_explain_dependency(spark):
    g = build(spark, "a>b b>c a>c", extra=["z"])
    both = E.explain_dependency(g, "a", "c")
    assert both["is_direct"] and both["is_transitive"] and "both directly and transitively" in both["explanation"] and both["paths"] == [["a", "b", "c"], ["a", "c"]]
    assert "single edge" in E.explain_dependency(g, "a", "b")["explanation"]
    assert "No path" in E.explain_dependency(g, "c", "a")["explanation"]
    with pytest.raises(GraphError, match="target"):
        E.explain_dependency(g, "a", "q")


def test_diff_and_validate(spark):
    a, b = build(spark, "a>b:1 b>c:2"), build(spark, "a>b:5 a>d:1")
    d = diff(a, b)
    assert [r.id for r in d["nodes_added"].collect()] == ["d"] and [r.id for r in d["nodes_removed"].collect()] == ["c"]
    assert [(r.src, r.dst) for r in d["edges_added"].collect()] == [("a", "d")] and [(r.src, r.dst) for r in d["edges_removed"].collect()] == [("b", "c")]
    assert [tuple(r) for r in d["weights_changed"].collect()] == [("a", "b", 1.0, 5.0)]
    with pytest.raises(GraphError):
        diff(a, build(spark, "a>b", False))
    flipped = diff(build(spark, "b>a:1", False), build(spark, "a>b:1", False))
    assert all(f.isEmpty() for f in flipped.values())
    assert validate(a).collect() == []
    bad = PropertyGraph(a.vertices.filter("id <> 'c'").union(a.vertices.filter("id = 'a'")), a.edges.union(a.edges.filter("src = 'a'")), True)
    assert [(r.type, r.message) for r in validate(bad).collect()] == [("count_mismatch", 'edge "a"->"b" occurs 2 times'), ("count_mismatch", 'node "a" occurs 2 times'), ("dangling_edge", 'edge target "c" not in nodes')]
