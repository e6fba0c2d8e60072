import io
import json

import pytest

from lattica.operators.lookup import roots
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources import loaders, snapshot
from lattica.sources.catalog import GraphCatalog
from lattica.sources.templates import template, template_list
from lattica.streaming.transitions import apply_events, degree_counts
from lattica.tools import ToolServer
from tests.test_traverse import build, ids


def test_snapshot_round_trip(spark):
    g = PropertyGraph.build(spark, [{"id": "c"}, {"id": "a", "label": "A", "meta": {"n": 10, "f": 1.5}}, {"id": "b", "schema": {"k": {"type": "int", "required": True}}}], [{"src": "b", "dst": "a", "weight": 2, "meta": {"w": [1]}}], directed=False)
    text = snapshot.marshal(g)
    assert text == snapshot.marshal(snapshot.unmarshal(spark, text))
    doc = json.loads(text)
    assert [n["id"] for n in doc["graph"]["nodes"]] == ["a", "b", "c"] and doc["graph"]["edges"][0]["from"] == "a"
    assert doc["metadata"]["nodes"][0]["entries"] == {"n": 10, "f": 1.5} and doc["metadata"]["nodes"][1]["id"] == "b"
    assert "schema" not in json.loads(snapshot.marshal(g, schemas=False, indent=False))["metadata"]["nodes"][0]
    assert "metadata" not in json.loads(snapshot.marshal(g, ["a"], meta=False)) and len(json.loads(snapshot.marshal(g, ["a"]))["graph"]["nodes"]) == 1
    for bad in ('{"version": 2}', "nope", '{"version":1,"directed":true,"graph":{"nodes":[{"id":"a"}],"edges":[{"from":"a","to":"z"}]}}'):
        with pytest.raises(GraphError):
            snapshot.unmarshal(spark, bad)


def test_apply_meta(spark):
    g = build(spark, "a>b")
    doc = {"version": 9, "metadata": {"nodes": [{"id": "a", "entries": {"k": 1}, "schema": {"lang": {"type": "string", "required": True}}}, {"id": "z", "entries": {"k": 1}}], "edges": [{"from": "a", "to": "z", "entries": {"k": 1}}]}}
    out = snapshot.apply_meta(json.dumps(doc), g)
    assert out.order() == 2 and list(out.vertices.filter("id = 'a'").first().meta) == ["k"] and out.vertices.filter("id = 'a'").first().meta_schema["lang"].required
    again, places = snapshot.import_(spark, snapshot.export(out, {"a": {"x": 1, "y": 2}}))
    assert again.size() == 1 and places["a"] == {"x": 1, "y": 2} and set(places) == {"a", "b"}


def test_directory_and_plan(spark):
    rows = [("src", "src", True, 0, ""), ("src/a.go", "a.go", False, 5, "x"), ("docs/deep/b.md", "b.md", False, 1, ""), ("old", "old", True, 0, ""), ("old/er", "er", True, 0, "")]
    entries = spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, content string")
    g = loaders.from_directory(entries)
    assert ids(g.vertices) == ["docs/deep", "docs/deep/b.md", "old", "old/er", "root", "src", "src/a.go"] and ids(roots(g)) == ["docs/deep", "root"]
    meta = g.vertices.selectExpr("id", "to_json(meta) AS m").filter("id = 'src/a.go'").first().m
    assert json.loads(meta) == {"type": "file", "size": 5, "extension": ".go", "language": "Go", "content": "x"}
    assert ids(loaders.from_directory(entries, extensions=[" GO "]).vertices) == ["root", "src", "src/a.go"]
    tasks = spark.createDataFrame([("a", "", "done", None), ("b", "B", "", ["a", "q"]), ("c", "", "", ["b"])], "id string, label string, status string, dependencies array<string>")
    assert {r.id: (r.label, r.status) for r in loaders.from_plan(tasks).vertices.collect()} == {"a": ("a", "done"), "b": ("B", "ready"), "c": ("c", "pending")}
    looped = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "id string, dependencies array<string>")
    assert loaders.plan_levels(looped).count() == 2


def test_templates(spark):
    assert {t["id"]: (t["node_count"], t["edge_count"]) for t in template_list()}["codebase"] == (25, 30)
    assert ids(roots(template(spark, "microservices"))) == ["gateway", "products"]
    with pytest.raises(GraphError):
        template(spark, "none")


def test_catalog(spark, tmp_path):
    c = GraphCatalog(spark, f"file://{tmp_path}/graphs")
    with pytest.raises(GraphError):
        c.save("one")
    c.upsert("one", [{"id": "a", "meta": {"k": 1}}], [{"from": "a", "to": "b"}])
    c.save("one")
    (tmp_path / "graphs" / "two.json").write_text(snapshot.export(build(spark, "x>y")))
    (tmp_path / "graphs" / "junk.json").write_text("{")
    fresh = GraphCatalog(spark, f"file://{tmp_path}/graphs")
    assert [(g["name"], g["node_count"], g["edge_count"]) for g in fresh.list()] == [("one", 2, 1), ("two", 2, 1)]
    assert list(fresh.open("one").vertices.filter("id = 'a'").first().meta) == ["k"]
    fresh.upsert("one", [{"id": "z"}])
    fresh.save("one")
    assert fresh.open("one").order() == 3
    fresh.delete("one"), fresh.delete("one"), fresh.delete("two")
    assert fresh.list() == []
    for bad in ("../evil", "foo/bar", "..\\evil", "a..b/c", "..", "foo\\bar", " "):
        with pytest.raises(GraphError):
            c.open(bad)


def test_tool_round_trip(spark, tmp_path):
    server = ToolServer(GraphCatalog(spark, f"file://{tmp_path}/g"))
    calls = [
        ("open_graph", {"name": "g"}), ("upsert", {"graph": "g", "nodes": [{"id": "a", "status": "running"}], "edges": [{"from": "a", "to": "b", "weight": 1}, {"from": "b", "to": "c", "weight": 2}]}),
        ("transition", {"graph": "g", "id": "a", "status": "done"}), ("save_graph", {"name": "g"}), ("shortest_path", {"graph": "g", "src": "a", "dst": "c"}), ("mst", {"graph": "g"}), ("bfs", {"graph": "  ", "start": "a"}), ("bfs", {"graph": "g"}), ("delete_graph", {"name": "g"}),
    ]
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": a}}) for i, (n, a) in enumerate(calls)]
    lines += ["", "{", json.dumps({"jsonrpc": "2.0", "id": 90, "method": "tools/list"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 91, "method": "odd"}), json.dumps({"jsonrpc": "2.0", "id": 92, "method": "tools/call", "params": {"name": "odd"}}), json.dumps({"jsonrpc": "2.0", "id": 93, "method": "initialize"})]
    out = io.StringIO()
    server.run(io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    text = [json.loads(g["result"]["content"][0]["text"]) if "result" in g and not g["result"].get("isError") else None for g in got[:9]]
    assert text[0] == {"name": "g", "node_count": 0, "edge_count": 0, "directed": True} and text[1]["nodes_created"] == 3 and text[2]["new_status"] == "done"
    assert text[4] == {"path": ["a", "b", "c"], "cost": 3.0} and text[5:8] == [None] * 3 and text[8] == {"ok": True}
    assert got[9]["error"]["code"] == -32700 and len(got[10]["result"]["tools"]) == 35
    assert [g.get("error", {}).get("code") for g in got[11:]] == [-32601, -32602, None] and got[13]["result"]["protocolVersion"] == "2024-11-05"


def test_streams(spark, tmp_path):
    events = [("a", 1, "pending"), ("a", 2, "ready"), ("a", 3, "done"), ("b", 1, "ready"), ("a", 4, "running")]
    spark.createDataFrame(events, "id string, seq long, status string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, seq long, status string").parquet(f"{tmp_path}/in")
    q = apply_events(stream).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable(), q.stop()
    rows = {(r.id, r.seq): (r.new_status, r.accepted) for r in spark.table("steps").collect()}
    assert rows == {("a", 1): ("pending", True), ("a", 2): ("ready", True), ("a", 3): ("ready", False), ("b", 1): ("ready", True), ("a", 4): ("running", True)}
    edges = spark.readStream.schema("id string, seq long, status string").parquet(f"{tmp_path}/in").selectExpr("id AS src", "status AS dst")
    q = degree_counts(edges).writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    q.processAllAvailable(), q.stop()
    assert {r.id: r.out_degree for r in spark.table("degrees").collect()} == {"a": 4, "b": 1}
