"""The tool table over a graph catalog, and a JSON-RPC 2.0 loop on lines of text."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import functions as F

from lattica.operators import components, explain, kernels, lookup, rank, traverse
from lattica.operators.compare import diff
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources.catalog import GraphCatalog

PROTOCOL = "2024-11-05"
MOST_LINE = 1 << 20


def ids(frame, order: str = "id") -> list[str]:
    return [r.id for r in frame.orderBy(order).select("id").collect()]


def groups(frame) -> list[list[str]]:
    rows = frame.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("m")).orderBy("component")
    return [r.m for r in rows.collect()]


def scores(frame) -> dict:
    return {"scores": {r.id: r.score for r in frame.collect()}}


def edge_rows(frame) -> list[dict]:
    return [{"from": r["src"], "to": r["dst"], **{k: r[k] for k in r.asDict() if k not in ("src", "dst")}} for r in frame.collect()]


def path_of(g: PropertyGraph, src: str, dst: str) -> dict:
    path, cost = traverse.shortest_path(g, src, dst)
    return {"path": path, "cost": cost}


def spanning(g: PropertyGraph) -> dict:
    rows = edge_rows(components.minimum_spanning_forest(g))
    return {"edges": rows, "total_weight": sum(r["weight"] for r in rows)}


def cycle(g: PropertyGraph) -> dict:
    found = kernels.cycle_path(g)
    return {"has_cycle": bool(found), "cycle": found}


def closure(g: PropertyGraph) -> dict:
    c = traverse.transitive_closure(g)
    rows = edge_rows(c.edges.select("src", "dst").orderBy("src", "dst"))
    return {"node_count": c.order(), "edge_count": len(rows), "edges": rows}


def valid(g: PropertyGraph) -> dict:
    errors = [r.asDict() for r in components.validate(g).collect()]
    return {"valid": not errors, "errors": errors}


def ranks(g: PropertyGraph, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> dict:
    frame, iterations, converged = rank.pagerank(g, damping, max_iter, tolerance)
    return {**scores(frame), "iterations": iterations, "converged": converged}


def pairs(g: PropertyGraph) -> dict:
    out: dict = {"dist": {}, "next": {}}
    for r in traverse.all_pairs(g).collect():
        out["dist"].setdefault(r.src, {})[r.dst] = r.dist
        if r["next"] is not None:
            out["next"].setdefault(r.src, {})[r.dst] = r["next"]
    return out


def critical(g: PropertyGraph) -> dict:
    rows, length = traverse.critical_path(g)
    order = {i: n for n, i in enumerate(ids(kernels.topological_sort(g), "ord"))}
    found = rows.collect()
    return {"path": sorted((r.id for r in found if r.critical), key=order.get), "length": length, "node_slack": {r.id: r.slack for r in found}}


def flow(g: PropertyGraph, source: str, sink: str) -> dict:
    value, sent, cut = kernels.max_flow(g, source, sink)
    net: dict = {}
    for r in sent.collect():
        net.setdefault(r.src, {})[r.dst] = r.flow
    return {"max_flow": value, "flow": net, "min_cut": edge_rows(cut)}


def differences(a: PropertyGraph, b: PropertyGraph) -> dict:
    d = diff(a, b)
    out = {k: ids(d[k]) if k.startswith("nodes") else edge_rows(d[k]) for k in d}
    return {k.replace("src", "from"): v for k, v in out.items()}


TEXT, FLAG, WHOLE, NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "integer"}, {"type": "number"}
TEXTS = {"type": "array", "items": TEXT}


def objects(needed: tuple[str, ...], **properties: dict) -> dict:
    return {"type": "array", "items": {"type": "object", "properties": properties, "required": list(needed)}}


OPEN = {"type": "object"}
NODES = objects(("id",), id=TEXT, label=TEXT, status=TEXT, meta=OPEN, delete=TEXTS)
EDGES = objects(("from", "to"), **{"from": TEXT, "to": TEXT, "label": TEXT, "weight": NUMBER, "meta": OPEN, "delete": TEXTS})
PAIRS = objects(("from", "to"), **{"from": TEXT, "to": TEXT})
FILTERS = objects(("key", "op"), key=TEXT, op=TEXT | {"enum": ["eq", "neq", "contains", "gt", "gte", "lt", "lte", "exists"]}, value={})


def table(c: GraphCatalog) -> dict[str, tuple[str, dict, set, Callable]]:
    """name -> (description, argument schemas, required ones, handler). Algorithms run on the
    named graph, which is made empty and directed if it is unknown."""
    one = {"graph": TEXT}

    def on(f: Callable) -> Callable:
        return lambda graph, **a: f(c.open(graph), **a)

    def add(description: str, f: Callable, more: dict | None = None, optional: tuple = ()) -> tuple:
        schema = one | (more or {})
        return description, schema, set(schema) - set(optional), on(f)

    name = {"name": TEXT}
    return {
        "open_graph": ("Open or create a named graph", name | {"directed": FLAG}, {"name"}, lambda name, directed=True: (c.open(name, directed), c.info(name))[1]),
        "save_graph": ("Store a graph", name, {"name"}, lambda name: c.save(name)),
        "list_graphs": ("List graphs", {}, set(), lambda: c.list()),
        "delete_graph": ("Delete a graph", name, {"name"}, lambda name: c.delete(name)),
        "graph_summary": ("Structure of a graph", name, {"name"}, lambda name: c.summary(name)),
        "upsert": ("Create or update nodes, edges and metadata", one | {"nodes": NODES, "edges": EDGES}, {"graph"}, lambda graph, nodes=(), edges=(): c.upsert(graph, nodes, edges)),
        "read_nodes": ("Read nodes by id or filter, in pages", one | {"ids": TEXTS, "keys": TEXTS, "filters": FILTERS, "include_edges": FLAG, "offset": WHOLE, "limit": WHOLE}, {"graph"}, lambda graph, **a: c.read_nodes(graph, **a)),
        "transition": ("Change a node's status", one | {"id": TEXT, "status": TEXT}, {"graph", "id", "status"}, lambda graph, id, status: c.transition(graph, id, status)),  # noqa: A002
        "remove": ("Remove nodes and edges", one | {"nodes": TEXTS, "edges": PAIRS}, {"graph"}, lambda graph, nodes=(), edges=(): c.remove(graph, nodes, edges)),
        "scc": add("Strongly connected components", lambda g: {"components": groups(components.strongly_connected(g))}),
        "mst": add("Minimum spanning forest", spanning),
        "bfs": add("Breadth-first order", lambda g, start: {"order": ids(traverse.bfs(g, start), "ord")}, {"start": TEXT}),
        "dfs": add("Depth-first order", lambda g, start: {"order": ids(kernels.dfs(g, start), "ord")}, {"start": TEXT}),
        "shortest_path": add("Shortest path", path_of, {"src": TEXT, "dst": TEXT}),
        "topological_sort": add("Smallest topological order", lambda g: {"order": ids(kernels.topological_sort(g), "ord")}),
        "cycle_detect": add("Find a cycle", cycle),
        "connected_components": add("Connected components", lambda g: {"components": groups(components.connected(g))}),
        "ancestors": add("Nodes that reach a node", lambda g, id: {"ancestors": ids(traverse.ancestors(g, id))}, {"id": TEXT}),  # noqa: A002
        "descendants": add("Nodes that a node reaches", lambda g, id: {"descendants": ids(traverse.descendants(g, id))}, {"id": TEXT}),  # noqa: A002
        "roots": add("Nodes without a way in", lambda g: {"roots": ids(lookup.roots(g))}),
        "leaves": add("Nodes without a way out", lambda g: {"leaves": ids(lookup.leaves(g))}),
        "transitive_closure": add("All reachable pairs", closure),
        "validate_graph": add("Check a graph's tables", valid),
        "diff_graphs": ("Differences of two graphs", {"graph_a": TEXT, "graph_b": TEXT}, {"graph_a", "graph_b"}, lambda graph_a, graph_b: differences(c.open(graph_a), c.open(graph_b))),
        "degree_centrality": add("Degree centrality", lambda g: scores(rank.degree_centrality(g))),
        "betweenness_centrality": add("Betweenness centrality", lambda g: scores(rank.betweenness(g))),
        "closeness_centrality": add("Closeness centrality", lambda g: scores(rank.closeness(g))),
        "pagerank": add("PageRank", ranks, {"damping": NUMBER, "max_iter": WHOLE, "tolerance": NUMBER}, ("damping", "max_iter", "tolerance")),
        "all_pairs_shortest_paths": add("Distances of all pairs", pairs),
        "critical_path": add("Critical path", critical),
        "max_flow": add("Greatest flow and its cut", flow, {"source": TEXT, "sink": TEXT}),
        "explain_path": add("Explain a shortest path", lambda g, src, dst: explain.explain_path(g, src, dst), {"src": TEXT, "dst": TEXT}),
        "explain_component": add("Explain a node's component", lambda g, id: explain.explain_component(g, id), {"id": TEXT}),  # noqa: A002
        "explain_centrality": add("Explain a node's rank", lambda g, id: explain.explain_centrality(g, id), {"id": TEXT}),  # noqa: A002
        "explain_dependency": add("Explain a dependency", lambda g, src, dst: explain.explain_dependency(g, src, dst), {"src": TEXT, "dst": TEXT}),
    }


class ToolServer:
    """Answers JSON-RPC requests, one a line; tool failures are results marked as errors."""

    def __init__(self, catalog: GraphCatalog):
        self.catalog, self.tools = catalog, table(catalog)

    def definitions(self) -> list[dict]:
        return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": sorted(r)}} for n, (d, p, r, _) in self.tools.items()]

    def call(self, name: str, arguments: dict | None = None) -> Any:
        """Runs one tool. Missing or unknown arguments are an error; so are blank graph names."""
        _, known, needed, run = self.tools[name]
        args = {k: v for k, v in (arguments or {}).items() if v is not None}
        if missing := sorted(needed - set(args)):
            raise GraphError(f"missing argument {missing[0]}")
        for key in ("name", "graph", "graph_a", "graph_b"):
            if key in args and not str(args[key]).strip():
                raise GraphError("graph name must not be empty")
        return run(**{k: v for k, v in args.items() if k in known})

    def handle(self, request: dict) -> dict | None:
        method, id_ = request.get("method"), request.get("id")

        def reply(**body) -> dict:
            return {"jsonrpc": "2.0", "id": id_, **body}

        if method == "initialize":
            return reply(result={"protocolVersion": PROTOCOL, "serverInfo": {"name": "lattica", "version": "0.1.0"}, "capabilities": {"tools": {}}})
        if method == "notifications/initialized":
            return None
        if method == "tools/list":
            return reply(result={"tools": self.definitions()})
        if method != "tools/call":
            return reply(error={"code": -32601, "message": f"method not found: {method}"})
        params = request.get("params")
        if not isinstance(params, dict):
            return reply(error={"code": -32602, "message": "invalid params"})
        if params.get("name") not in self.tools:
            return reply(error={"code": -32602, "message": f"unknown tool: {params.get('name')}"})
        try:
            text = json.dumps(self.call(params["name"], params.get("arguments")))
        except Exception as error:  # noqa: BLE001  any failure of a tool is its answer
            return reply(result={"content": [{"type": "text", "text": str(error)}], "isError": True})
        return reply(result={"content": [{"type": "text", "text": text}]})

    def run(self, source: IO[str], sink: IO[str]) -> None:
        """Reads requests until the input ends; a line over 1 MiB ends it with an error."""
        for line in source:
            if not line.strip():
                continue
            if len(line) > MOST_LINE:
                raise GraphError("line too long")
            try:
                request = json.loads(line)
            except ValueError:
                answer: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            else:
                answer = self.handle(request)
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
