"""Degree, closeness, betweenness, PageRank, graph statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import connected
from lattica.operators.lookup import degrees, leaves, roots
from lattica.operators.traverse import grown, pair_levels, source_batches, whole
from lattica.plans.graph import PropertyGraph
from lattica.plans.ordering import with_ordinal
from lattica.plans.scratch import cut


def degree_centrality(g: PropertyGraph) -> DataFrame:
    """K1: (id, score): out-degree, or degree if undirected, over n - 1; 0 for n <= 1."""
    n = g.order()
    return degrees(g).select("id", (F.col("out_degree") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)).alias("score"))


def ranking(scores: DataFrame) -> DataFrame:
    """(id, score, rank) with rank by score descending, then id. Ranges of the order number
    their own rows, so no task sorts the whole table."""
    return with_ordinal(scores.select("id", "score"), [F.col("score").desc(), F.col("id")], "rank", 1)


def closeness(g: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """K3: (id, score): nodes reachable over the sum of their distances; 0 if there are none."""
    arcs = cut(g.arcs().select("src", "dst").distinct())
    per = []
    for ids in source_batches(g, sources):
        far = whole(pair_levels(arcs, ids)).filter("d > 0").groupBy(F.col("s").alias("id")).agg((F.count("*") / F.sum("d")).alias("score"))
        per = grown(per, cut(ids.join(far, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))))
    return whole(per)


def betweenness(g: PropertyGraph) -> DataFrame:
    """K2: (id, score): shortest paths through a node, ends excluded; halved if undirected.

    Breadth-first tables, one for each distance, for a batch of sources at a time; then
    dependencies are gathered from the farthest nodes back, each table touched once.
    """
    arcs = cut(g.arcs().filter("src <> dst").select("src", "dst").distinct())
    sums = []
    for ids in source_batches(g):
        levels = pair_levels(arcs, ids)
        if not levels:
            continue
        far, parts = levels[-1].withColumn("delta", F.lit(0.0)), []
        for near in reversed(levels[1:-1]):  # the first table holds the sources themselves
            share = far.select("s", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("w"))
            gain = share.join(arcs, "dst").join(near.select("s", F.col("id").alias("src"), F.col("sigma").alias("sv")), ["s", "src"]).groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("sv") * F.col("w")).alias("delta"))
            far = cut(near.join(gain, ["s", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))))
            parts = grown(parts, far.groupBy("id").agg(F.sum("delta").alias("score")))
        if parts:
            sums = grown(sums, cut(whole(parts).groupBy("id").agg(F.sum("score").alias("score"))))
    half = 1.0 if g.directed else 0.5
    if not sums:
        return g.vertices.select("id", F.lit(0.0).alias("score"))
    total = whole(sums).groupBy("id").agg(F.sum("score").alias("score"))
    return g.vertices.select("id").join(total, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * half).alias("score"))


def pagerank(g: PropertyGraph, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """K4: (id, score), iterations run and whether the greatest change fell under the tolerance.

    Unweighted; the rank of nodes without a way out is spread over all nodes. One join and
    one sum an iteration; the dangling mass and the change come from one small aggregate.
    """
    arcs = cut(g.arcs().select("src", "dst").distinct())
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    state = cut(g.vertices.select("id").join(out, "id", "left"))
    n = state.count()
    if not n:
        return state.select("id", F.lit(0.0).alias("score")), 0, True
    state = state.withColumn("r", F.lit(1.0 / n))
    dangling = state.filter("out IS NULL").count() / n
    for i in range(1, max_iter + 1):
        sent = arcs.join(state.filter("out IS NOT NULL").select(F.col("id").alias("src"), (F.col("r") / F.col("out")).alias("w")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w"))
        base = (1 - damping) / n + damping * dangling / n
        state = cut(state.join(sent, "id", "left").select("id", "out", F.col("r").alias("old"), (F.lit(base) + damping * F.coalesce("w", F.lit(0.0))).alias("r")))
        row = state.agg(F.max(F.abs(F.col("r") - F.col("old"))).alias("change"), F.sum(F.when(F.col("out").isNull(), F.col("r"))).alias("dangling")).first()
        dangling = row.dangling or 0.0
        if row.change < tolerance:
            return state.select("id", F.col("r").alias("score")), i, True
    return state.select("id", F.col("r").alias("score")), max_iter, False


def diameter(g: PropertyGraph, components: int | None = None) -> int:
    """The greatest distance in the undirected view; -1 if empty or not connected."""
    parts = components if components is not None else connected(g).select("component").distinct().count()
    if parts != 1:
        return -1
    arcs = cut(g.links().select("src", "dst").distinct())
    return max(len(pair_levels(arcs, ids)) - 1 for ids in source_batches(g))


def analytics(g: PropertyGraph, with_diameter: bool = True) -> DataFrame:
    """A1: one row of node_count, edge_count, directed, density, avg_degree, max_in_degree,
    max_out_degree, diameter, components. Per-node degrees come from ``degrees``."""
    per = cut(degrees(g))
    counts = per.agg(F.count("*").alias("n"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("mi"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("mo")).first()
    e, n = g.size(), counts.n
    parts = connected(g).select("component").distinct().count()
    pairs = n * (n - 1) / (1 if g.directed else 2)
    row = (n, e, g.directed, e / pairs if n > 1 else 0.0, (e if g.directed else 2 * e) / n if n else 0.0, counts.mi, counts.mo, diameter(g, parts) if with_diameter and n else -1, parts)
    schema = "node_count long, edge_count long, directed boolean, density double, avg_degree double, max_in_degree long, max_out_degree long, diameter int, components long"
    return g.vertices.sparkSession.createDataFrame([row], schema)


def status_counts(g: PropertyGraph) -> DataFrame:
    """(status, nodes); the empty status reads (none)."""
    return g.vertices.groupBy(F.when(F.col("status") == "", "(none)").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("nodes"))


def summary(g: PropertyGraph, name: str) -> dict:
    """Name, counts, roots, leaves, status histogram and structure."""
    row = analytics(g).first().asDict()
    ids = {k: [r.id for r in f(g).select("id").collect()] for k, f in (("roots", roots), ("leaves", leaves))}
    return {"name": name, **{k: row[k] for k in ("node_count", "edge_count", "directed")}, **ids, "status_counts": {r.status: r.nodes for r in status_counts(g).collect()}, **{k: row[k] for k in ("components", "density", "avg_degree", "diameter")}}
