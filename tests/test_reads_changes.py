import pytest
from pyspark.sql import functions as F

from lattica.functions import meta as M
from lattica.functions.filters import matches
from lattica.operators import lookup as L
from lattica.operators import mutate as U
from lattica.operators import tasks as J
from lattica.plans.graph import GraphError, PropertyGraph
from tests.test_traverse import build, ids

ROWS = [
    {"id": "a", "label": "Alpha", "status": "done", "meta": {"priority": 10.0, "tag": "core"}},
    {"id": "b", "label": "Beta", "status": "pending", "meta": {"priority": 5.0}},
    {"id": "c", "label": "Charlie", "status": "running", "meta": {"priority": 8.0, "tag": "ui"}},
    {"id": "d", "label": "Delta", "status": "done", "meta": {"priority": 3.0}},
]


@pytest.fixture(scope="module")
def four(spark):
    edges = [{"src": a, "dst": b, "label": "dep", "meta": {"priority": 1, "x": 2}} for a, b in ("ab", "ac", "cd")]
    return PropertyGraph.build(spark, ROWS, edges).materialize()


def test_read_nodes(four):
    assert ids(L.read_nodes(four, ["a", "c", "zz"])["nodes"]) == ["a", "c"]
    assert ids(L.read_nodes(four, ["c", "a", "c"])["nodes"]) == ["a", "c", "c"]
    assert ids(L.read_nodes(four, filters=[{"key": "status", "op": "eq", "value": "done"}])["nodes"]) == ["a", "d"]
    page = L.read_nodes(four, ["a", "b", "c"], keys=["priority"], include_edges=True)
    assert {(r.src, r.dst) for r in page["edges"].collect()} == {("a", "b"), ("a", "c")}
    assert [list(r.meta) for r in page["edges"].collect()] == [["priority"]] * 2
    a = page["nodes"].filter("id = 'a'").first()
    assert (a.in_degree, a.out_degree, list(a.meta)) == (0, 2, ["priority"])
    for offset, more in ((0, True), (2, False)):
        page = L.read_nodes(four, offset=offset, limit=2)
        assert page["nodes"].count() == 2 and page["total"] == 4 and page["has_more"] is more
    assert L.read_nodes(four, offset=9)["nodes"].count() == 0 and L.read_nodes(four, limit=0)["total"] == 4
    assert L.read_nodes(four, keys=["nothing"])["nodes"].first().meta is None
    with pytest.raises(GraphError):
        L.read_nodes(four, offset=-1)


@pytest.mark.parametrize(
    ("key", "op", "value", "who"),
    [
        ("status", "eq", "done", "ad"), ("status", "neq", "done", "bc"), ("label", "contains", "lph", "a"), ("priority", "gt", 9, "a"), ("priority", "gt", 10, ""), ("priority", "lt", 10, "bcd"), ("priority", "gte", 5, "abc"), ("priority", "lte", 4, "d"),
        ("tag", "exists", None, "ac"), ("priority", "eq", 10, "a"), ("priority", "eq", 9, ""), ("priority", "neq", 10, "bcd"), ("tag", "neq", "core", "bcd"), ("status", "regex", "x", ""), ("tag", "lt", 5, ""), ("priority", "contains", 10, "a"), ("priority", "eq", "10", "a"),
    ],
)
def test_filters(four, key, op, value, who):
    assert "".join(ids(four.vertices.filter(matches({"key": key, "op": op, "value": value})))) == who


def test_filter_compatibility(four):
    assert ids(four.vertices.filter(matches({"key": "tag", "op": "lt", "value": 5}, compat=True))) == list("abcd")


def test_lookups(spark, four):
    assert ids(L.neighbors(four, "a")) == ["b", "c"] and ids(L.neighbors(four, "q")) == []
    assert [r.dst for r in L.out_edges(four, "a").collect()] == ["b", "c"] and [r.src for r in L.in_edges(four, "d").collect()] == ["c"]
    assert ids(L.roots(four)) == ["a"] and ids(L.leaves(four)) == ["b", "d"]
    und = build(spark, "b>a", False)
    assert L.has_edge(und, "a", "b") and L.has_edge(und, "b", "a") and und.size() == 1
    loop = build(spark, "a>a")
    assert loop.size() == 1 and ids(L.roots(loop)) == [] and build(spark, "a>a", False).size() == 1
    sub = L.subgraph(four, ["a", "b", "nowhere"])
    assert sub.order() == 2 and sub.size() == 1
    assert four.has("a") and not four.has("q")
    with pytest.raises(GraphError):
        PropertyGraph.build(spark, ["a"], [("a", "z")])


def test_metadata_functions(spark):
    g = PropertyGraph.build(spark, [{"id": "s", "meta": dict.fromkeys("abcde", 1)}])
    for offset, limit, n, more in ((0, 2, 2, True), (2, 2, 2, True), (4, 2, 1, False), (10, 2, 0, False), (0, 0, 5, False), (-3, 1, 1, True)):
        p = g.vertices.select(M.page(F.col("meta"), offset, limit).alias("p")).first().p
        assert (len(p["items"]), p.total, p.has_more) == (n, 5, more)
    row = g.vertices.select(M.keys(M.drop(M.put(F.col("meta"), "z", {"k": 1}), "a")).alias("k"), M.has(F.col("meta"), "a").alias("h"), M.get(F.col("meta"), "q").alias("g"), M.count(F.col("meta")).alias("n"), M.until(F.col("meta"), lambda k, v: k == "b").alias("u")).first()
    assert (row.k, row.h, row.g, row.n, len(row.u)) == (list("bcdez"), True, None, 5, 2)


def test_schema(spark):
    kinds = {"string": "x", "int": 1, "float": 7.5, "bool": True, "slice": [1], "map": {"a": 1}, "any": None}
    schema = {f"f_{k}": {"type": k, "required": True} for k in kinds} | {"name": {"type": "string", "required": True}, "age": {"type": "int", "required": False}, "odd": {"type": "nothing", "required": False}}
    good = {"id": "g", "meta": {f"f_{k}": v for k, v in kinds.items()} | {"name": "n", "extra": 1}, "schema": schema}
    bad = {"id": "b", "meta": {"f_string": 123, "odd": 1} | {f"f_{k}": v for k, v in kinds.items() if k != "string"}, "schema": schema}
    g = PropertyGraph.build(spark, [good, bad, {"id": "free", "meta": {"q": 1}}])
    assert [tuple(r) for r in M.schema_errors(g.vertices).collect()] == [("b", "f_string", 'field "f_string": expected type string, got BIGINT'), ("b", "name", 'missing required field "name"'), ("b", "odd", 'field "odd": expected type nothing, got BIGINT')]


def test_upsert(spark):
    g = PropertyGraph.empty(spark)
    g, r = U.upsert(g, [{"id": "n", "label": "N", "meta": {"a": 1, "b": 2}, "delete": ["b"]}, {"id": ""}], [{"from": "x", "to": "y", "weight": 5, "meta": {"k": 1}}])
    assert r == {"nodes_created": 3, "nodes_updated": 0, "edges_created": 1, "edges_updated": 0, "meta_keys_set": 3, "meta_keys_deleted": 1}
    g, r = U.upsert(g, [{"id": "n", "label": "N"}], [{"from": "x", "to": "y"}])
    assert r["nodes_updated"] == r["edges_updated"] == r["nodes_created"] == 0
    g, r = U.upsert(g, [{"id": "n", "label": "", "status": "s"}], [{"from": "x", "to": "y", "weight": 0, "label": "l"}])
    e = g.edges.first()
    assert (r["nodes_updated"], r["edges_updated"], e.weight, e.label, list(e.meta)) == (1, 1, 0.0, "l", ["k"])
    assert g.vertices.filter("id = 'n'").select("label", "status").first() == ("N", "s")


def test_other_changes(spark):
    g = build(spark, "x>y y>z")
    out, r = U.remove(g, ["z", "nowhere"], [("x", "y")])
    assert r == {"nodes_removed": 1, "edges_removed": 1} and out.size() == 0 and out.order() == 2
    more = spark.createDataFrame([("x", "X"), ("w", "W")], "id string, label string")
    assert {r.id: r.label for r in U.add_nodes(g, more).vertices.collect()} == {"x": "X", "y": "", "z": "", "w": "W"}
    with pytest.raises(GraphError):
        U.add_edges(g, spark.createDataFrame([("x", "q")], "src string, dst string"))
    both = build(spark, "a>b:1 b>a:4")
    und = U.set_directed(both, False)
    assert [(r.src, r.dst, r.weight) for r in und.edges.collect()] == [("a", "b", 4.0)] and U.clear(und).order() == 0
    tagged = U.set_edge_meta(und, "b", "a", "k", [1])
    assert list(tagged.edges.first().meta) == ["k"] and not U.delete_edge_meta(tagged, "a", "b", "k").edges.first().meta
    noted = U.set_node_meta(g, "x", "k", 1)
    assert [r.n for r in U.delete_node_meta(noted, "x", "k").vertices.select(M.count(F.col("meta")).alias("n")).collect()] == [0, 0, 0]
    for f in (lambda: U.set_node_meta(g, "q", "k", 1), lambda: U.set_node_meta(g, "x", "", 1), lambda: U.set_edge_meta(g, "x", "z", "k", 1)):
        with pytest.raises(GraphError):
            f()


def test_transitions(spark):
    rows = [{"id": i, "status": s} for i, s in (("a", "running"), ("b", "running"), ("c", "pending"), ("r", "ready"))]
    g = PropertyGraph.build(spark, rows, [("a", "c"), ("b", "c"), ("a", "r")]).materialize()
    g, r = J.transition(g, "a", "done")
    assert r == {"id": "a", "old_status": "running", "new_status": "done", "newly_ready": []}
    g, r = J.transition(g, "b", "done")
    assert r["newly_ready"] == ["c"]
    for bad in (("a", "ready"), ("q", "done"), ("c", "odd")):
        with pytest.raises(GraphError):
            J.transition(g, *bad)
    fresh = PropertyGraph.build(spark, ["n"])
    for s in ("pending", "ready", "running", "failed", "pending"):
        fresh, _ = J.transition(fresh, "n", s)


def test_readiness_rules_differ(spark):
    g = PropertyGraph.build(spark, [{"id": "free", "status": "pending"}, {"id": "d", "status": "done"}, {"id": "t", "status": "pending"}], [("d", "t")])
    assert ids(J.ready(g)[1]) == ["free", "t"]
    assert {r.id: r.status for r in J.compute_ready(g).vertices.collect()} == {"free": "pending", "d": "done", "t": "ready"}
    assert {r.id: r.status for r in J.set_status(g, "free", "skipped").vertices.collect()}["t"] == "ready"


def test_task_runs(spark):
    g = PropertyGraph.build(spark, [{"id": i, "status": "pending"} for i in ("t1", "t2", "t3")])
    g = J.add_dependency(J.add_dependency(g, "t3", "t1"), "t3", "t2")
    done = []
    out, errors = J.run(g, done.append, 2)
    assert sorted(done[:2]) == ["t1", "t2"] and done[2] == "t3" and not errors

    def fail(task):
        if task == "t1":
            raise ValueError(task)

    out, errors = J.run(J.reset(out), fail, 0)
    assert list(errors) == ["t1"] and {r.id: r.status for r in out.vertices.collect()} == {"t1": "failed", "t2": "done", "t3": "pending"}
    with pytest.raises(GraphError):
        J.transition_task(out, "t1", "ready")


def test_cancelled_run(spark):
    g = PropertyGraph.build(spark, [{"id": i, "status": "pending"} for i in "abcd"], [("a", "d")], True)
    seen = []
    with pytest.raises(J.RunCancelled) as stop:
        J.run(g, lambda i: None, 1, lambda: ("b", "done") in seen, lambda *x: seen.append(x))
    assert seen == [("a", "running"), ("a", "done"), ("b", "running"), ("b", "done")] and stop.value.errors == {}
    assert {r.id: r.status for r in stop.value.graph.vertices.collect()} == {"a": "done", "b": "done", "c": "ready", "d": "pending"}
    with pytest.raises(J.RunCancelled) as stop:
        J.run(g, lambda i: 1 / 0, 2, lambda: True)
    assert {r.status for r in stop.value.graph.vertices.collect()} == {"ready", "pending"}
