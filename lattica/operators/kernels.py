"""Orders and flows that are sequential by nature: one executor task for a graph.

Searches and flows are first cut down, by distributed steps, to what lies between their
ends; the lexicographic order and the first cycle need the whole graph. A graph beyond
``limit`` edges is an error, so that no task gathers more than it can hold.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.traverse import cyclic_core, reach
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.plans.onetask import children_of, one_task
from lattica.plans.scratch import cut

LIMIT = 5_000_000


def dfs(g: PropertyGraph, start: str, stop: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, ord) in preorder, neighbours ascending; no rows for an unknown start. Only
    what the start reaches enters the kernel. ``stop`` is a condition on vertex columns; the
    visit ends after the first node that meets it."""
    first = g.vertices.filter(F.col("id") == start).select("id")
    inside = reach(g.arcs(), first).union(first).distinct()
    ends = g.vertices.select(F.col("id").alias("src"), F.coalesce(stop if stop is not None else F.lit(False), F.lit(False)).alias("last"))
    rows = inside.withColumnRenamed("id", "src").join(ends, "src", "left").join(g.arcs().select("src", "dst"), "src", "left")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        children, seen, order, stack = children_of(pdf), set(), [], [start]
        last = set(pdf.loc[pdf["last"].fillna(False).astype(bool), "src"])
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                order.append(v)
                if v in last:
                    break
                stack += [c for c in reversed(children[v]) if c not in seen]
        return pd.DataFrame({"id": order, "ord": range(len(order))})

    return one_task(rows, visit, "id string, ord long", limit)


def topological_sort(g: PropertyGraph, limit: int = LIMIT) -> DataFrame:
    """T4: (id, ord), the lexicographically smallest order. A cycle is an error."""
    g.need_directed("topological order")
    if not cyclic_core(g).isEmpty():
        raise GraphError("graph contains a cycle")
    rows = g.vertices.select(F.col("id").alias("src")).join(g.edges.select("src", "dst"), "src", "left")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        children, waits = children_of(pdf), dict.fromkeys(pdf["src"], 0)
        for cs in children.values():
            for c in cs:
                waits[c] += 1
        ready = [v for v, n in waits.items() if n == 0]
        heapq.heapify(ready)
        out = []
        while ready:
            v = heapq.heappop(ready)
            out.append(v)
            for c in children[v]:
                waits[c] -= 1
                if waits[c] == 0:
                    heapq.heappush(ready, c)
        return pd.DataFrame({"id": out, "ord": range(len(out))})

    return one_task(rows, order, "id string, ord long", limit)


def cycle_path(g: PropertyGraph, limit: int = LIMIT) -> list[str]:
    """T5: the cycle that the first back edge of a sorted depth-first search closes, ending at
    its target; [] without a cycle or if undirected. All nodes take part as starts, since
    they decide from where the cyclic part is entered."""
    if not g.directed or cyclic_core(g).isEmpty():
        return []
    rows = g.vertices.select(F.col("id").alias("src")).join(g.edges.select("src", "dst"), "src", "left")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        children, state = children_of(pdf), {}
        for root in sorted(set(pdf["src"])):
            if root in state:
                continue
            state[root], path, todo = 1, [root], [iter(children[root])]
            while todo:
                nxt = next(todo[-1], None)
                if nxt is None:
                    state[path.pop()] = 2
                    todo.pop()
                elif state.get(nxt) == 1:
                    at = path.index(nxt)
                    cycle = [*path[at + 1 :], nxt] if nxt != path[-1] else [nxt, nxt]
                    return pd.DataFrame({"id": cycle, "ord": range(len(cycle))})
                elif nxt not in state:
                    state[nxt] = 1
                    path.append(nxt)
                    todo.append(iter(children[nxt]))
        return pd.DataFrame({"id": [], "ord": []})

    return [r.id for r in one_task(rows, find, "id string, ord long", limit).orderBy("ord").collect()]


def max_flow(g: PropertyGraph, source: str, sink: str, limit: int = LIMIT) -> tuple[float, DataFrame, DataFrame]:
    """K6: the greatest flow, (src, dst, flow) of edges with positive net flow, and the
    (src, dst) of the cut nearest to the source.

    Only edges between what the source reaches and what reaches the sink can carry flow;
    augmenting paths are found breadth-first, neighbours ascending.
    """
    g.need_directed("max flow")
    g.require(source=source, sink=sink)
    if source == sink:
        raise GraphError("source and sink must differ")
    start, end = (g.vertices.filter(F.col("id") == x).select("id") for x in (source, sink))
    flipped = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead = reach(g.edges, start).union(start).distinct()
    behind = reach(flipped, end).union(end).distinct()
    useful = ahead.join(behind, "id", "left_semi")
    rows = g.edges.select("src", "dst", "weight").join(useful.withColumnRenamed("id", "src"), "src", "left_semi").join(useful.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def push(pdf: pd.DataFrame) -> pd.DataFrame:
        room: dict[str, dict[str, float]] = defaultdict(dict)
        for a, b, w in pdf[["src", "dst", "weight"]].itertuples(index=False):
            if a != b and w > 0:
                room[a][b] = room[a].get(b, 0.0) + w
                room[b].setdefault(a, 0.0)
        full, order = {a: dict(m) for a, m in room.items()}, {a: sorted(m) for a, m in room.items()}
        while True:
            before, queue = {source: None}, deque([source])
            while queue and sink not in before:
                v = queue.popleft()
                for w in order.get(v, ()):
                    if w not in before and room[v][w] > 0:
                        before[w] = v
                        queue.append(w)
            if sink not in before:
                break
            path, v = [], sink
            while before[v] is not None:
                path.append((before[v], v))
                v = before[v]
            step = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= step
                room[b][a] += step
        out = [("flow", a, b, full[a][b] - room[a][b]) for a in full for b in full[a] if full[a][b] - room[a][b] > 0]
        out += [("cut", a, b, full[a][b]) for a in full for b in full[a] if a in before and b not in before and full[a][b] > 0]
        return pd.DataFrame(out, columns=["kind", "src", "dst", "amount"])

    found = cut(one_task(rows, push, "kind string, src string, dst string, amount double", limit))
    flow = found.filter("kind = 'flow'").select("src", "dst", F.col("amount").alias("flow")).orderBy("src", "dst")
    out_of = flow.filter(F.col("src") == source).agg(F.sum("flow")).first()[0] or 0.0
    into = flow.filter(F.col("dst") == source).agg(F.sum("flow")).first()[0] or 0.0
    return out_of - into, flow, found.filter("kind = 'cut'").select("src", "dst").orderBy("src", "dst")
