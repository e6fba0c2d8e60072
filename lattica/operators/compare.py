"""Differences between two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.graph import GraphError, PropertyGraph


def diff(a: PropertyGraph, b: PropertyGraph) -> dict[str, DataFrame]:
    """nodes_added, nodes_removed (id); edges_added, edges_removed (src, dst, weight);
    weights_changed (src, dst, old_weight, new_weight), each in order. Payload and metadata
    do not count. One full outer join of the edges, two anti-joins of the nodes."""
    if a.directed != b.directed:
        raise GraphError("cannot compare a directed with an undirected graph")
    va, vb = a.vertices.select("id"), b.vertices.select("id")
    both = a.edges.select("src", "dst", F.col("weight").alias("old_weight")).join(b.edges.select("src", "dst", F.col("weight").alias("new_weight")), ["src", "dst"], "full_outer")
    return {
        "nodes_added": vb.join(va, "id", "left_anti").orderBy("id"),
        "nodes_removed": va.join(vb, "id", "left_anti").orderBy("id"),
        "edges_added": both.filter("old_weight IS NULL").select("src", "dst", F.col("new_weight").alias("weight")).orderBy("src", "dst"),
        "edges_removed": both.filter("new_weight IS NULL").select("src", "dst", F.col("old_weight").alias("weight")).orderBy("src", "dst"),
        "weights_changed": both.filter("old_weight <> new_weight").orderBy("src", "dst"),
    }
