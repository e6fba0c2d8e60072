"""Plain-language reports on paths, components, centrality and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators.components import strongly_connected
from lattica.operators.lookup import has_edge, in_edges, neighbors, out_edges
from lattica.operators.rank import degree_centrality, ranking
from lattica.operators.traverse import shortest_path, simple_paths
from lattica.plans.graph import PropertyGraph
from lattica.plans.scratch import cut

PREVIEW = 5  # the wording of the sentences below is fixed: clients read it


def explain_path(g: PropertyGraph, source: str, target: str) -> dict:
    """The shortest path, its steps and a sentence."""
    path, cost = shortest_path(g, source, target)
    hops = list(zip(path, path[1:]))
    weights = {}
    if hops:
        wanted = g.vertices.sparkSession.createDataFrame(hops, "src string, dst string")
        weights = {(r.src, r.dst): r.weight for r in g.arcs().join(F.broadcast(wanted), ["src", "dst"]).collect()}  # one row a hop
    steps = [f"Step {i}: '{a}' -> '{b}' (weight: {weights[a, b]:.2f})" for i, (a, b) in enumerate(hops, 1)]
    text = f"There is a path of {len(hops)} hop(s) from '{source}' to '{target}' with a total weight of {cost:.2f}. The path traverses through {len(path)} node(s): {' -> '.join(path)}."
    return {"source": source, "destination": target, "path": path, "path_length": len(hops), "total_weight": cost, "explanation": text, "steps": steps}


def explain_component(g: PropertyGraph, node: str) -> dict:
    """The node's component (strong if directed), its number by smallest member, members
    and the node's links inside it."""
    g.require(node=node)
    parts = cut(strongly_connected(g))
    own = parts.filter(F.col("id") == node).first().component
    inside = parts.filter(F.col("component") == own).select("id")
    members = [r.id for r in inside.orderBy("id").collect()]
    names = parts.select("component").distinct()
    number, total = names.filter(F.col("component") <= own).count(), names.count()
    ahead = [r.id for r in neighbors(g, node).join(inside, "id", "left_semi").orderBy("id").collect()]
    links = [f"'{node}' is directly connected to '{n}'" for n in ahead]
    for r in in_edges(g, node).select(F.col("src").alias("id")).join(inside, "id", "left_semi").orderBy("id").collect():
        if not any(f"'{r.id}'" in line for line in links):
            links.append(f"'{node}' receives an edge from '{r.id}'")
    kind = "strongly connected component" if g.directed else "connected component"
    text = f"Node '{node}' belongs to {kind} #{number}, which contains {len(members)} node(s): [{', '.join(members)}]. The graph has {total} {kind}(s) in total."
    return {"node_id": node, "component_id": number, "component_size": len(members), "members": members, "explanation": text, "connections": links}


def explain_centrality(g: PropertyGraph, node: str) -> dict:
    """The node's place by degree centrality and what makes it."""
    g.require(node=node)
    row = ranking(degree_centrality(g)).filter(F.col("id") == node).first()
    total = g.order()
    near = neighbors(g, node)
    n_near, n_in = near.count(), in_edges(g, node).count()
    first = [r.id for r in near.limit(PREVIEW).collect()]
    factors = [f"Out-degree: {out_edges(g, node).count()}", f"In-degree: {n_in}"] if g.directed else [f"Degree: {n_near}"]
    factors.append(f"Neighbor count: {n_near}")
    if n_near:
        factors.append(f"Connected to: {', '.join(first)}" + (f", ... and {n_near - PREVIEW} more" if n_near > PREVIEW else ""))
    text = f"Node '{node}' is ranked #{row['rank']} out of {total} nodes by degree centrality with a score of {row.score:.4f}."
    return {"node_id": node, "rank": row["rank"], "score": row.score, "total_nodes": total, "explanation": text, "factors": factors}


def explain_dependency(g: PropertyGraph, source: str, target: str) -> dict:
    """Whether the source depends on the target directly, through others, both or not."""
    g.require(source=source, target=target)
    direct = has_edge(g, source, target)
    paths = [r.path for r in simple_paths(g, source, target).collect()]
    n = len(paths)
    if direct and n > 1:
        text = f"'{source}' has a direct dependency on '{target}' and there are {n} path(s) between them. This means '{source}' depends on '{target}' both directly and transitively."
    elif direct:
        text = f"'{source}' has a direct dependency on '{target}' via a single edge."
    elif n:
        text = f"'{source}' has a transitive (indirect) dependency on '{target}' through {n} path(s). There is no direct edge from '{source}' to '{target}'."
    else:
        text = f"There is no dependency from '{source}' to '{target}'. No path exists between these nodes in the given direction."
    return {"source": source, "target": target, "is_direct": direct, "is_transitive": n > 0, "paths": paths, "explanation": text}
