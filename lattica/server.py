"""The HTTP surface: one working graph with node positions, its algorithms, loaders and files."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import functions as F

from lattica import tools
from lattica.functions import meta as M
from lattica.operators import lookup, mutate, rank, traverse
from lattica.operators import tasks as J
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources import loaders, snapshot, templates
from lattica.sources.catalog import GraphCatalog, checked

META_PAGE = 50


class NotFound(GraphError):
    """A node or edge of a metadata request that the graph does not have."""


class GraphService:
    """Routes to functions of the working graph. Requests run one at a time."""

    def __init__(self, catalog: GraphCatalog, directed: bool = True):
        self.catalog, self.spark = catalog, catalog.spark
        self.graph, self.positions = PropertyGraph.empty(self.spark, directed), {}
        self.lock = threading.Lock()
        self.routes: dict[str, Callable[[dict, dict], object]] = {
            "/api/graph": lambda b, q: self.shown(),
            "/api/graph/directed": lambda b, q: self.now(mutate.set_directed(self.graph, bool(b["directed"]))),
            "/api/graph/clear": lambda b, q: self.replaced(mutate.clear(self.graph), {}),
            "/api/graph/export": lambda b, q: json.loads(snapshot.export(self.graph, self.positions)),
            "/api/graph/import": lambda b, q: self.replaced(*snapshot.import_(self.spark, json.dumps(b))),
            "/api/node/add": self.add_node,
            "/api/node/remove": self.remove_node,
            "/api/node/position": self.move,
            "/api/node/status": lambda b, q: self.now(J.set_status(self.graph, b["id"], b["status"])),
            "/api/edge/add": self.add_edge,
            "/api/edge/remove": lambda b, q: self.now(mutate.remove(self.graph, edges=[(b["from"], b["to"])])[0]),
            "/api/templates": lambda b, q: templates.template_list(),
            "/api/template/load": lambda b, q: self.replaced(templates.template(self.spark, b["id"]), templates.positions(b["id"])),
            "/api/algo": lambda b, q: self.shown(self.algorithm(q.get("algo", ""), b)),
            "/api/plan/load": self.load_plan,
            "/api/directory/load": self.load_directory,
            "/api/files/list": lambda b, q: self.catalog.list(),
            "/api/files/load": self.load_file,
            "/api/files/save": self.save_file,
            "/api/node/meta": lambda b, q: self.meta_page(self.node_rows(b), b),
            "/api/node/meta/set": lambda b, q: self.changed(self.node_rows(b), lambda: mutate.set_node_meta(self.graph, b["id"], b.get("key", ""), b.get("value"))),
            "/api/node/meta/delete": lambda b, q: self.changed(self.node_rows(b), lambda: mutate.delete_node_meta(self.graph, b["id"], b.get("key", ""))),
            "/api/edge/meta": lambda b, q: self.meta_page(self.edge_rows(b), b),
            "/api/edge/meta/set": lambda b, q: self.changed(self.edge_rows(b), lambda: mutate.set_edge_meta(self.graph, b["from"], b["to"], b.get("key", ""), b.get("value"))),
            "/api/edge/meta/delete": lambda b, q: self.changed(self.edge_rows(b), lambda: mutate.delete_edge_meta(self.graph, b["from"], b["to"], b.get("key", ""))),
        }

    def handle(self, path: str, body: dict | None = None, query: dict | None = None) -> tuple[int, object]:
        """(status, JSON value): 404 for unknown routes and owners, 400 for bad requests."""
        route = self.routes.get(path)
        if route is None:
            return 404, {"error": "not found"}
        with self.lock:
            try:
                return 200, route(body or {}, query or {})
            except NotFound as error:
                return 404, {"error": str(error)}
            except (GraphError, KeyError, ValueError, TypeError) as error:
                return 400, {"error": str(error)}

    def shown(self, result: dict | None = None) -> dict:
        """The working graph as the page draws it; a picture, so as large as a page can show."""
        count = M.count(F.col("meta")).alias("metaCount")
        nodes = self.graph.vertices.select("id", "label", "status", count).orderBy("id").collect()
        edges = self.graph.edges.select("src", "dst", "label", "weight", count).orderBy("src", "dst").collect()
        place = {"x": 0.0, "y": 0.0}
        out = {"directed": self.graph.directed, "nodes": [{**r.asDict(), **self.positions.get(r.id, place)} for r in nodes], "edges": [{"from": r.src, "to": r.dst, "label": r.label, "weight": r.weight, "metaCount": r.metaCount} for r in edges]}
        return out | ({"result": result} if result is not None else {})

    def now(self, g: PropertyGraph) -> dict:
        self.graph = g.materialize()
        return self.shown()

    def replaced(self, g: PropertyGraph, positions: dict) -> dict:
        self.positions = dict(positions)
        return self.now(g)

    def add_node(self, body: dict, _: dict) -> dict:
        if not body.get("id"):
            raise GraphError("id is required")
        row = self.spark.createDataFrame([(body["id"], body.get("label") or body["id"])], "id string, label string")
        self.positions[body["id"]] = {"x": float(body.get("x") or 0), "y": float(body.get("y") or 0)}
        return self.now(mutate.add_nodes(self.graph, row))

    def remove_node(self, body: dict, _: dict) -> dict:
        self.positions.pop(body["id"], None)
        return self.now(mutate.remove(self.graph, [body["id"]])[0])

    def move(self, body: dict, _: dict) -> None:
        self.positions[body["id"]] = {"x": float(body["x"]), "y": float(body["y"])}

    def add_edge(self, body: dict, _: dict) -> dict:
        row = self.spark.createDataFrame([(body["from"], body["to"], float(body.get("weight") or 0), body.get("label") or "")], "src string, dst string, weight double, label string")
        return self.now(mutate.add_edges(self.graph, row))

    def load_plan(self, body: dict, _: dict) -> dict:
        rows = [(t["id"], t.get("label") or "", t.get("status") or "", list(t.get("dependencies") or [])) for t in body.get("tasks") or []]
        plan = self.spark.createDataFrame(rows, "id string, label string, status string, dependencies array<string>")
        given = {t["id"]: {"x": float(t.get("x") or 0), "y": float(t.get("y") or 0)} for t in body.get("tasks") or []}
        if any(p == {"x": 0.0, "y": 0.0} for p in given.values()):
            given = {r.id: {"x": r.x, "y": r.y} for r in loaders.layout(loaders.plan_levels(plan)).collect()}
        return self.replaced(loaders.from_plan(plan), given)

    def load_directory(self, body: dict, _: dict) -> dict:
        rows = [(e["path"], e["name"], bool(e.get("isDir")), int(e.get("size") or 0), e.get("content") or "") for e in body.get("entries") or []]
        root = body.get("rootName") or "root"
        g = loaders.from_directory(self.spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, content string"), root, body.get("extensions") or [])
        depth = F.when(F.col("id") == root, 0).otherwise(F.length("id") - F.length(F.replace(F.col("id"), F.lit("/"), F.lit(""))) + 1)
        return self.replaced(g, {r.id: {"x": r.x, "y": r.y} for r in loaders.layout(g.vertices.select("id", depth.alias("level")), centred=True).collect()})

    def save_file(self, body: dict, _: dict) -> dict:
        self.catalog.put(body["name"], self.graph)
        saved = self.catalog.save(body["name"])
        self.catalog.write_text(self.catalog.path(body["name"], "positions.json"), json.dumps(self.positions, sort_keys=True))
        return saved

    def load_file(self, body: dict, _: dict) -> dict:
        g, path = self.catalog.open(checked(body["name"]), create=False), self.catalog.path(body["name"], "positions.json")
        return self.replaced(g, snapshot.placed(g, json.loads(self.catalog.read_text(path)) if self.catalog.exists(path) else {}))

    def node_rows(self, body: dict):
        rows = lookup.node(self.graph, body["id"])
        if rows.isEmpty():
            raise NotFound("node not found")
        return rows

    def edge_rows(self, body: dict):
        rows = lookup.edge(self.graph, body["from"], body["to"])
        if rows.isEmpty():
            raise NotFound("edge not found")
        return rows

    def meta_page(self, rows, body: dict) -> dict:
        limit = int(body.get("limit") or 0)
        page = M.page(F.col("meta"), int(body.get("offset") or 0), limit if limit > 0 else META_PAGE)
        found = json.loads(rows.select(F.to_json(page).alias("p")).first().p)
        return {"items": found["items"], "total": found["total"], "offset": found["offset"], "hasMore": found["has_more"]}

    def changed(self, _, change: Callable[[], PropertyGraph]) -> dict:
        return self.now(change())

    def algorithm(self, name: str, body: dict) -> dict:
        """One algorithm's result with what to highlight; failures are part of the result."""
        g, out = self.graph, {"algorithm": name}
        single = {"bfs": lambda s: tools.ids(traverse.bfs(g, s), "ord"), "dfs": lambda s: tools.ids(tools.kernels.dfs(g, s), "ord"), "ancestors": lambda s: tools.ids(traverse.ancestors(g, s)), "descendants": lambda s: tools.ids(traverse.descendants(g, s))}
        try:
            if name in single:
                if not (start := body.get("start")):
                    raise GraphError("start node required")
                found = single[name](start)
                walk = name in ("bfs", "dfs")
                return out | ({"visitedOrder": found, "highlightNodes": found, "highlightEdges": consecutive(found)} if walk else {name: found, "highlightNodes": [*found, start]})
            if name == "shortest-path":
                path = tools.path_of(g, body["start"], body["end"])
                return out | path | {"highlightNodes": path["path"], "highlightEdges": consecutive(path["path"])}
            if name == "topo-sort":
                order = tools.ids(tools.kernels.topological_sort(g), "ord")
                return out | {"order": order, "highlightNodes": order}
            if name == "cycle-detect":
                found = tools.cycle(g)
                return out | {"hasCycle": found["has_cycle"], "cycle": found["cycle"], "highlightNodes": found["cycle"], "highlightEdges": consecutive(found["cycle"] + found["cycle"][:1])}
            if name in ("components", "scc"):
                parts = tools.groups(tools.components.connected(g) if name == "components" else tools.components.strongly_connected(g))
                return out | {"components": parts, "highlightNodes": [i for p in parts for i in p]}
            if name in ("roots", "leaves"):
                found = tools.ids(getattr(lookup, name)(g))
                return out | {name: found, "highlightNodes": found}
            if name == "mst":
                tree = tools.spanning(g)
                pairs = [[e["from"], e["to"]] for e in tree["edges"]]
                return out | {"mstEdges": pairs, "mstWeight": tree["total_weight"], "highlightEdges": pairs, "highlightNodes": sorted({i for p in pairs for i in p})}
            if name == "analytics":
                return out | {"analytics": rank.analytics(g).first().asDict()}
            raise GraphError(f"unknown algorithm: {name}")
        except (GraphError, KeyError) as error:
            return out | {"error": str(error)}


def consecutive(path: list[str]) -> list[list[str]]:
    return [list(p) for p in zip(path, path[1:])]


def serve(service: GraphService, host: str = "127.0.0.1", port: int = 8090) -> ThreadingHTTPServer:
    """An HTTP server for the service; call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, value = service.handle(url.path, body, dict(parse_qsl(url.query)))
            except ValueError as error:
                status, value = 400, {"error": str(error)}
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
