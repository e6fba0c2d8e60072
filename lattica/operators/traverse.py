"""Traversals, reachability, shortest paths, critical path and simple paths as DataFrame loops.

Each loop keeps its state in a checkpointed table and runs until a round changes nothing.
State joins are equi-joins on node ids; Catalyst broadcasts a side only if it is small.
A graph of at most SMALL arcs goes through one task instead, with the same result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.graph import GraphError, PropertyGraph
from lattica.plans.onetask import children_of, one_task
from lattica.plans.ordering import with_ordinal
from lattica.plans.scratch import cut

GUARD = 100_000  # nodes for results that have a row for each pair of nodes
MERGE = 32  # level tables that a loop keeps apart
SMALL = 200_000  # arcs that one task walks faster than a loop of jobs does


def whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def grown(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """``parts`` and one more table; many are merged, so that plans stay short."""
    return [*parts, new] if len(parts) < MERGE else [cut(whole([*parts, new]))]


def bfs(g: PropertyGraph, start: str, stop: Column | None = None) -> DataFrame:
    """(id, ord, level) in queue order with neighbours ascending.

    A level's nodes are ordered by the place of the first node that reached them, then by
    id, which is the order of the queue. An unknown start gives no rows. ``stop`` is a
    condition on vertex columns; the visit ends after the first node that meets it.
    """
    arcs = cut(g.arcs().select("src", "dst").distinct())
    out = bfs_in_one_task(g, arcs, start) if arcs.count() <= SMALL else bfs_by_levels(g, arcs, start)
    if stop is not None:
        last = out.join(g.vertices.filter(stop).select("id"), "id", "left_semi").agg(F.min("ord")).first()[0]
        out = out if last is None else out.filter(F.col("ord") <= last)
    return out


def bfs_in_one_task(g: PropertyGraph, arcs: DataFrame, start: str) -> DataFrame:
    first = g.vertices.filter(F.col("id") == start).select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst"))

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        children, level = children_of(pdf.dropna(subset=["src"])), {}
        if pdf["src"].isna().any():
            level, queue = {start: 0}, deque([start])
            while queue:
                v = queue.popleft()
                for c in children.get(v, ()):
                    if c not in level:
                        level[c] = level[v] + 1
                        queue.append(c)
        return pd.DataFrame({"id": pd.Series(list(level), dtype=object), "ord": range(len(level)), "level": pd.Series(list(level.values()), dtype="int32")})

    return one_task(arcs.union(first), visit, "id string, ord long, level int", SMALL + 1)


def bfs_by_levels(g: PropertyGraph, arcs: DataFrame, start: str) -> DataFrame:
    front = cut(g.vertices.filter(F.col("id") == start).select("id", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("level")))
    levels, base, depth = [front], 1, 0
    while not front.isEmpty():
        found = arcs.join(front.select(F.col("id").alias("src"), "ord"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("ord").alias("by"))
        fresh = found.join(whole(levels).select("id"), "id", "left_anti")
        numbered = with_ordinal(fresh, [F.col("by"), F.col("id")], "ord", base)
        depth += 1
        front = cut(numbered.select("id", "ord", F.lit(depth).alias("level")))
        levels = grown(levels, front)
        base += front.count()
    return whole(levels)


def reach(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(id): all nodes at the end of a walk of one step or more from the start ids."""
    arcs = cut(arcs.select("src", "dst").distinct())
    front, found = start.select("id"), []
    while True:
        step = arcs.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        for x in found:
            step = step.join(x, "id", "left_anti")
        front = cut(step)
        if front.isEmpty():
            return reduce(DataFrame.union, found, front)
        found = [cut(reduce(DataFrame.union, [*found, front]))]


def descendants(g: PropertyGraph, id_: str) -> DataFrame:
    """Nodes reachable from the node, itself only if it lies on a cycle; by id."""
    return reach(g.arcs(), g.vertices.filter(F.col("id") == id_)).orderBy("id")


def ancestors(g: PropertyGraph, id_: str) -> DataFrame:
    """Nodes that reach the node, itself only if it lies on a cycle; by id."""
    flipped = g.arcs().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(flipped, g.vertices.filter(F.col("id") == id_)).orderBy("id")


def transitive_closure(g: PropertyGraph) -> PropertyGraph:
    """An edge of weight 1 from every node to every other node it reaches.

    Semi-naive: a round joins only the pairs that the last one found with the edges, and
    keeps those not known before.
    """
    g.need_directed("transitive closure")
    arcs = cut(g.edges.select("src", "dst").distinct())
    fresh, known = arcs, [arcs]
    while not fresh.isEmpty():
        longer = fresh.withColumnRenamed("dst", "mid").join(arcs.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = cut(longer.join(whole(known), ["src", "dst"], "left_anti"))
        known = grown(known, fresh)
    return PropertyGraph.of(g.vertices, whole(known).filter("src <> dst").withColumn("weight", F.lit(1.0)))


def distances(g: PropertyGraph, source: str, target: str | None = None) -> DataFrame:
    """Shortest distances from the source: (id, dist, pred_dist, pred); unreachable nodes are absent.

    Only nodes improved in the last round relax their edges, and a round adds its improvements
    to those before; nothing else is written again. Of equally short ways the predecessor
    nearer to the source wins, then the smaller id. With a target, ways no shorter than the
    best one to it are dropped. Negative weights are an error.
    """
    arcs = cut(g.arcs())
    if not arcs.filter("weight < 0").limit(1).isEmpty():
        raise GraphError("shortest paths need weights of 0 or more")
    if arcs.count() <= SMALL:
        return distances_in_one_task(g, arcs, source)
    none = F.lit(None).cast("string")
    changed = cut(g.vertices.filter(F.col("id") == source).select("id", F.struct(F.lit(0.0).alias("dist"), F.lit(-1.0).alias("pred_dist"), none.alias("pred")).alias("b")))
    known = [changed]
    while not changed.isEmpty():
        offers = arcs.join(changed.select(F.col("id").alias("src"), F.col("b.dist").alias("d")), "src")
        offers = offers.select(F.col("dst").alias("id"), F.struct((F.col("d") + F.col("weight")).alias("dist"), F.col("d").alias("pred_dist"), F.col("src").alias("pred")).alias("n"))
        if target is not None:
            end = whole(known).filter(F.col("id") == target).agg(F.min("b.dist")).first()[0]
            offers = offers if end is None else offers.filter(F.col("n.dist") <= end)
        offers = offers.groupBy("id").agg(F.min("n").alias("n"))
        best = whole(known).join(offers.select("id"), "id", "left_semi").groupBy("id").agg(F.min("b").alias("b"))
        changed = cut(offers.join(best, "id", "left").filter(F.col("b").isNull() | (F.col("n") < F.col("b"))).select("id", F.col("n").alias("b")))
        known = grown(known, changed)
    return whole(known).groupBy("id").agg(F.min("b").alias("b")).select("id", "b.*")


def distances_in_one_task(g: PropertyGraph, arcs: DataFrame, source: str) -> DataFrame:
    first = g.vertices.filter(F.col("id") == source).select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for a, b, w in pdf.dropna(subset=["src"]).itertuples(index=False):
            out[a].append((b, w))
        best: dict[str, tuple[float, float, str | None]] = {}
        heap: list[tuple[float, float, str, str]] = [(0.0, -1.0, "", source)] if pdf["src"].isna().any() else []
        while heap:  # the least (distance, predecessor's distance, predecessor) of a node comes first
            d, before, by, v = heapq.heappop(heap)
            if v in best:
                continue
            best[v] = (d, before, by if before >= 0 else None)
            for b, w in out.get(v, ()):
                if b not in best:
                    heapq.heappush(heap, (d + w, d, v, b))
        rows = pd.DataFrame([(v, *x) for v, x in best.items()], columns=["id", "dist", "pred_dist", "pred"])
        return rows.astype({"id": object, "dist": float, "pred_dist": float, "pred": object})

    return one_task(arcs.select("src", "dst", "weight").union(first), settle, "id string, dist double, pred_dist double, pred string", SMALL + 1)


def shortest_path(g: PropertyGraph, source: str, target: str) -> tuple[list[str], float]:
    """The path and its cost. Missing ends and unreachable targets are errors."""
    g.require(source=source, destination=target)
    if source == target:
        return [source], 0.0
    best = cut(distances(g, source, target))
    hit = best.filter(F.col("id") == target).first()
    if hit is None:
        raise GraphError(f"no path from {source} to {target}")
    if best.count() <= SMALL:  # so are the rows that come to the driver
        pred = {r.id: r.pred for r in best.select("id", "pred").collect()}
    else:
        pred, at = {target: hit.pred}, hit.pred
        while at != source:  # one lookup for each node of the path
            pred[at] = best.filter(F.col("id") == at).first().pred
            at = pred[at]
    path = [target]
    while path[-1] != source:
        path.append(pred[path[-1]])
    return path[::-1], hit.dist


def all_pairs(g: PropertyGraph) -> DataFrame:
    """(src, dst, dist, next) for every pair with a path; next is null for src = dst.

    Min-plus doubling: a round joins the table with itself, so paths of up to 2**k edges are
    known after k rounds. A negative cycle is an error. Ties go to the smaller next hop.
    """
    n = g.order()
    if n > GUARD:
        raise GraphError(f"all pairs of {n} nodes exceed the limit of {GUARD} nodes")
    own = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.struct(F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("next")).alias("b"))
    step = g.arcs().select("src", "dst", F.struct(F.col("weight").alias("dist"), F.col("dst").alias("next")).alias("b"))
    # a null next sorts first, so a node's own distance of 0 wins over a loop of weight 0
    now = cut(own.union(step).groupBy("src", "dst").agg(F.min("b").alias("b")))
    for _ in range(max(1, (max(n, 2) - 1).bit_length()) + 1):
        left = now.select("src", F.col("dst").alias("mid"), F.col("b").alias("x"))
        right = now.select(F.col("src").alias("mid"), "dst", F.col("b").alias("y"))
        longer = left.join(right, "mid").select("src", "dst", F.struct((F.col("x.dist") + F.col("y.dist")).alias("dist"), F.coalesce("x.next", "y.next").alias("next")).alias("b"))
        new = cut(longer.groupBy("src", "dst").agg(F.min("b").alias("b")))
        if not new.filter("src = dst AND b.dist < 0").limit(1).isEmpty():
            raise GraphError("graph contains a negative cycle")
        same = new.count() == now.count() and new.join(now.withColumnRenamed("b", "o"), ["src", "dst"]).filter("b.dist <> o.dist").limit(1).isEmpty()
        now = new
        if same:
            break
    return now.select("src", "dst", "b.dist", F.when(F.col("src") != F.col("dst"), F.col("b.next")).alias("next"))


def reconstruct_path(pairs: DataFrame, source: str, target: str) -> list[str]:
    """The path that the next hops of ``all_pairs`` describe."""
    for role, id_ in (("source", source), ("destination", target)):
        if pairs.filter((F.col("src") == id_) & (F.col("dst") == id_)).limit(1).isEmpty():
            raise GraphError(f"{role} not in result")
    path = [source]
    while path[-1] != target:
        row = pairs.filter((F.col("src") == path[-1]) & (F.col("dst") == target)).first()
        if row is None or row.next is None:
            raise GraphError("no path")
        if row.next in path:
            raise GraphError("loop detected")
        path.append(row.next)
    return path


def cyclic_core(g: PropertyGraph) -> DataFrame:
    """T5: (src, dst) of the edges left when nodes without a way in or out are peeled off.
    Empty exactly if the directed graph has no cycle."""
    live = cut(g.edges.select("src", "dst").distinct())
    n = live.count()
    while n:
        heads = live.select(F.col("dst").alias("src")).distinct()
        tails = live.select(F.col("src").alias("dst")).distinct()
        live = cut(live.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        m = live.count()
        if m == n:
            break
        n = m
    return live


def has_cycle(g: PropertyGraph) -> bool:
    """T5: whether a directed graph has a cycle; false for an undirected one."""
    return g.directed and not cyclic_core(g).isEmpty()


def peel(vertices: DataFrame, arcs: DataFrame, start: float = 0.0) -> DataFrame:
    """(id, level, t) of every node that no cycle leads to: the greatest number of arcs on a way
    to it, and the greatest sum of weights of one, ``start`` at least and at its beginning.

    A round touches the arcs of the nodes that became free in the last one and the nodes that
    still wait for other predecessors, not the whole graph.
    """
    if arcs.count() <= SMALL and vertices.count() <= SMALL:
        return peel_in_one_task(vertices, arcs, start)
    waits = cut(arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")))
    front = cut(vertices.select("id").join(waits, "id", "left_anti").select("id", F.lit(0).alias("level"), F.lit(start).alias("t")))
    done, open_, level = [front], None, 0
    while not front.isEmpty():
        met = arcs.join(front.select(F.col("id").alias("src"), "t"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"), F.max(F.col("t") + F.col("weight")).alias("t"))
        if open_ is not None:
            met = met.union(open_).groupBy("id").agg(F.sum("c").alias("c"), F.max("t").alias("t"))
        state = cut(met.join(waits, "id").select("id", "c", "t", (F.col("c") == F.col("n")).alias("free")))
        level += 1
        front = state.filter("free").select("id", F.lit(level).alias("level"), F.greatest("t", F.lit(start)).alias("t"))
        open_ = state.filter("NOT free").select("id", "c", "t")
        done = grown(done, front)
    return whole(done)


def peel_in_one_task(vertices: DataFrame, arcs: DataFrame, start: float) -> DataFrame:
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[tuple[str, float]]] = defaultdict(list)
        waits = dict.fromkeys(pdf["src"], 0)
        for a, b, w in pdf.dropna(subset=["dst"]).itertuples(index=False):
            out[a].append((b, w))
            waits[b] = waits.get(b, 0) + 1
        level, t = {v: 0 for v, n in waits.items() if n == 0}, dict.fromkeys(waits, start)
        queue, deepest = deque(level), dict.fromkeys(waits, 0)
        while queue:
            v = queue.popleft()
            for b, w in out.get(v, ()):
                t[b], deepest[b] = max(t[b], t[v] + w), max(deepest[b], level[v] + 1)
                waits[b] -= 1
                if waits[b] == 0:
                    level[b] = deepest[b]
                    queue.append(b)
        return pd.DataFrame({"id": pd.Series(list(level), dtype=object), "level": pd.Series(list(level.values()), dtype="int32"), "t": pd.Series([t[v] for v in level], dtype=float)})

    rows = vertices.select(F.col("id").alias("src")).join(arcs.select("src", "dst", "weight"), "src", "left")
    return one_task(rows, walk, "id string, level int, t double", 2 * SMALL)


def peeled(g: PropertyGraph, what: str) -> tuple[DataFrame, DataFrame]:
    """The arcs of a directed graph and its peeled nodes; a cycle is an error."""
    g.need_directed(what)
    arcs = cut(g.edges.select("src", "dst", "weight"))
    out = cut(peel(g.vertices, arcs))
    if out.count() < g.order():
        raise GraphError("graph contains a cycle")
    return arcs, out


def topological_levels(g: PropertyGraph) -> DataFrame:
    """(id, level): the greatest number of edges on a way to the node. A valid order by
    (level, id), computed in parallel; the lexicographic order is a kernel."""
    return peeled(g, "topological order")[1].select("id", "level")


def critical_path(g: PropertyGraph) -> tuple[DataFrame, float]:
    """(id, earliest, latest, slack, critical) of every node, and the length.

    Critical nodes are all nodes of slack 0, which can form several parallel paths. Latest
    times are the earliest ones of the reversed graph, counted down from the length.
    """
    arcs, out = peeled(g, "critical path")
    early = out.select("id", F.col("t").alias("earliest"))
    length = float(early.agg(F.max("earliest")).first()[0] or 0.0)
    late = peel(g.vertices, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), -length)
    both = early.join(late.select("id", (0.0 - F.col("t")).alias("latest")), "id")
    return both.select("id", "earliest", "latest", (F.col("latest") - F.col("earliest")).alias("slack"), (F.col("latest") == F.col("earliest")).alias("critical")), length


def simple_paths(g: PropertyGraph, source: str, target: str, most: int = 5, hops: int = 10) -> DataFrame:
    """(path): the first ``most`` simple paths of up to ``hops`` edges, in lexicographic
    order of their nodes. Only nodes between the ends take part in the enumeration, and a
    prefix goes on only to nodes from which the hops left can reach the target."""
    spark = g.vertices.sparkSession
    if source == target:
        return spark.createDataFrame([([source],)], "path array<string>")
    start, end = (g.vertices.filter(F.col("id") == x) for x in (source, target))
    flipped = g.arcs().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    between = cut(reach(g.arcs(), start).union(start.select("id")).join(reach(flipped, end).union(end.select("id")), "id", "left_semi").distinct())
    arcs = cut(g.arcs().select("src", "dst").distinct().join(between.withColumnRenamed("id", "src"), "src", "left_semi").join(between.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    near = [cut(end.select("id", F.lit(0).alias("left")))]
    for left in range(1, hops):
        step = arcs.join(near[-1].select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        near.append(cut(step.join(whole(near), "id", "left_anti").select("id", F.lit(left).alias("left"))))
        if near[-1].isEmpty():
            break
    arcs = cut(arcs.join(whole(near).withColumnRenamed("id", "dst"), "dst").select("src", "dst", "left"))
    now = cut(start.select(F.array("id").alias("path")))
    done = []
    for used in range(1, hops + 1):
        longer = now.withColumn("src", F.element_at("path", -1)).join(arcs.filter(F.col("left") <= hops - used), "src").filter(~F.array_contains("path", F.col("dst")))
        longer = cut(longer.select(F.array_append("path", F.col("dst")).alias("path")))
        done.append(longer.filter(F.element_at("path", -1) == target).orderBy("path").limit(most))
        now = longer.filter(F.element_at("path", -1) != target)
        if now.isEmpty():
            break
    return reduce(DataFrame.union, done).orderBy("path").limit(most)


def source_batches(g: PropertyGraph, sources: DataFrame | None = None, size: int = 2_000):
    """The sources, or all nodes, in batches of a bounded number: a search from a batch has at
    most that many rows for each node."""
    ids = (sources if sources is not None else g.vertices).select("id").distinct()
    n = ids.count()
    if n <= size:
        yield cut(ids)
        return
    batches = -(-n // size)
    dealt = cut(ids.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))))
    for i in range(batches):
        yield dealt.filter(F.col("batch") == i).select("id")


def pair_levels(arcs: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """One table (s, id, d, sigma) for each distance d: the nodes that many steps from each
    source and the number of shortest paths. ``arcs`` are distinct and cut."""
    front = cut(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    levels, seen = [], [front.select("s", "id")]
    while not front.isEmpty():
        levels.append(front)
        step = front.select("s", F.col("id").alias("src"), "sigma").join(arcs, "src").groupBy("s", F.col("dst").alias("id")).agg(F.lit(len(levels)).alias("d"), F.sum("sigma").alias("sigma"))
        front = cut(step.join(whole(seen), ["s", "id"], "left_anti"))
        seen = grown(seen, front.select("s", "id"))
    return levels
