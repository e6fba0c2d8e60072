import json
import threading
import urllib.request

from lattica.server import GraphService, serve
from lattica.sources.catalog import GraphCatalog


def test_routes(spark, tmp_path):
    s = GraphService(GraphCatalog(spark, f"file://{tmp_path}/g"))

    def call(path, body=None, **query):
        status, value = s.handle(f"/api/{path}", body, query)
        assert status == 200, (path, value)
        return value

    assert len(s.routes) == 25 and s.handle("/api/none")[0] == 404
    call("node/add", {"id": "a", "x": 1, "y": 2})
    g = call("node/add", {"id": "b", "label": "B"})
    assert [(n["id"], n["label"], n["x"]) for n in g["nodes"]] == [("a", "a", 1.0), ("b", "B", 0.0)]
    assert call("edge/add", {"from": "a", "to": "b", "weight": 2})["edges"][0]["weight"] == 2
    assert s.handle("/api/edge/add", {"from": "a", "to": "q"})[0] == 400
    call("node/position", {"id": "b", "x": 5, "y": 6})
    call("node/meta/set", {"id": "a", "key": "k", "value": [1]})
    assert call("node/meta", {"id": "a"}) == {"items": [{"key": "k", "value": [1]}], "total": 1, "offset": 0, "hasMore": False}
    assert call("node/meta/delete", {"id": "a", "key": "k"})["nodes"][0]["metaCount"] == 0
    call("edge/meta/set", {"from": "a", "to": "b", "key": "k", "value": 1})
    assert call("edge/meta", {"from": "a", "to": "b"})["total"] == 1
    call("edge/meta/delete", {"from": "a", "to": "b", "key": "k"})
    assert s.handle("/api/node/meta", {"id": "q"})[0] == 404 and s.handle("/api/edge/meta", {"from": "b", "to": "a"})[0] == 404 and s.handle("/api/node/meta/set", {"id": "a"})[0] == 400
    assert call("algo", {"start": "a"}, algo="bfs")["result"]["highlightEdges"] == [["a", "b"]]
    assert call("algo", {}, algo="bfs")["result"]["error"] == "start node required"
    assert call("algo", {"start": "a", "end": "b"}, algo="shortest-path")["result"]["cost"] == 2
    for name in ("topo-sort", "cycle-detect", "components", "scc", "roots", "leaves", "analytics"):
        assert "error" not in call("algo", {}, algo=name)["result"]
    assert "error" in call("algo", {}, algo="mst")["result"] and "error" in call("algo", {}, algo="odd")["result"]
    saved = call("graph/export")
    call("files/save", {"name": "one"})
    assert call("files/list")[0]["name"] == "one"
    assert s.handle("/api/files/save", {"name": "../x"})[0] == 400 and s.handle("/api/files/load", {"name": "none"})[0] == 400
    assert call("graph/clear")["nodes"] == [] and len(call("graph/import", saved)["nodes"]) == 2
    assert call("graph/directed", {"directed": False})["directed"] is False
    loaded = call("files/load", {"name": "one"})["nodes"]
    assert [(n["id"], n["x"], n["y"]) for n in loaded] == [("a", 1.0, 2.0), ("b", 5.0, 6.0)]
    assert call("edge/remove", {"from": "a", "to": "b"})["edges"] == []
    assert len(call("node/remove", {"id": "a"})["nodes"]) == 1
    plan = {"tasks": [{"id": "t1", "status": "done"}, {"id": "t2", "dependencies": ["t1"]}]}
    g = call("plan/load", plan)
    assert [(n["status"], n["y"]) for n in g["nodes"]] == [("done", 80.0), ("ready", 230.0)]
    assert call("node/status", {"id": "t2", "status": "running"})["nodes"][1]["status"] == "running"
    tree = call("directory/load", {"rootName": "r", "entries": [{"path": "d/f.py", "name": "f.py", "size": 1}]})
    assert [(n["id"], n["x"], n["y"]) for n in tree["nodes"]] == [("d", 400.0, 230.0), ("d/f.py", 400.0, 380.0), ("r", 400.0, 80.0)]
    assert len(call("templates")) == 8 and all(t["description"] for t in call("templates"))
    chart = call("template/load", {"id": "orgchart"})["nodes"]
    assert len(chart) == 11 and {n["id"]: (n["x"], n["y"]) for n in chart}["ceo"] == (450.0, 50.0)
    tree = call("template/load", {"id": "codebase"})
    assert len(tree["nodes"]) == 25 and {e["label"] for e in tree["edges"]} == {"contains", "tested by"}


def test_http(spark, tmp_path):
    server = serve(GraphService(GraphCatalog(spark, f"file://{tmp_path}/g")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/graph"
    with urllib.request.urlopen(url, timeout=60) as answer:
        assert json.load(answer) == {"directed": True, "nodes": [], "edges": []}
    server.shutdown()
