"""Changes to a graph. Graphs are immutable: every change returns a new one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import meta as M
from lattica.plans.graph import EDGE_COLUMNS, META, VERTEX_COLUMNS, GraphError, PropertyGraph, canonical
from lattica.plans.scratch import cut

NODE_REQUEST = "at int, id string, label string, status string, meta string, del array<string>"
EDGE_REQUEST = "at int, src string, dst string, label string, weight double, meta string, del array<string>"


def ends(g: PropertyGraph, src: str, dst: str) -> tuple[str, str]:
    return (src, dst) if g.directed else (min(src, dst), max(src, dst))


def add_nodes(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """M1: inserts nodes or replaces their label and status; edges and metadata stay."""
    new = PropertyGraph.of(rows, g.edges.limit(0), True).vertices.alias("n")
    old = g.vertices.alias("o")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    there = F.col("n.id").isNotNull()
    return PropertyGraph(
        joined.select(
            F.coalesce("o.id", "n.id").alias("id"),
            *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("label", "status")],
            *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("meta", "meta_schema")],
        ),
        g.edges,
        g.directed,
    )


def add_edges(g: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """M2: inserts edges or replaces their weight and label, keeping metadata. A missing end
    is an error."""
    new = PropertyGraph.of(g.vertices, rows, g.directed).edges
    for end in ("src", "dst"):
        bad = new.select(F.col(end).alias("id")).join(g.vertices.select("id"), "id", "left_anti").first()
        if bad:
            raise GraphError(f"node {bad.id} not found")
    o, n = g.edges.alias("o"), new.alias("n")
    joined = o.join(n, (F.col("o.src") == F.col("n.src")) & (F.col("o.dst") == F.col("n.dst")), "full_outer")
    there = F.col("n.src").isNotNull()
    edges = joined.select(
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("src", "dst")],
        *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("weight", "label")],
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("meta", "meta_schema")],
    )
    return PropertyGraph(g.vertices, edges, g.directed)


def remove(g: PropertyGraph, nodes: list[str] = (), edges: list[tuple[str, str]] = ()) -> tuple[PropertyGraph, dict]:
    """M3, M4, M6: removes nodes with their edges, then edges. Unknown ones are ignored; edges
    that go with a node are not counted."""
    spark = g.vertices.sparkSession
    ids = spark.createDataFrame([(i,) for i in dict.fromkeys(nodes)], "id string")
    pairs = spark.createDataFrame(list(dict.fromkeys(ends(g, *e) for e in edges)), "src string, dst string")
    n = g.vertices.join(ids, "id", "left_semi").count()
    left = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    m = left.join(pairs, ["src", "dst"], "left_semi").count()
    kept = left.join(pairs, ["src", "dst"], "left_anti").select(g.edges.columns)
    return PropertyGraph(g.vertices.join(ids, "id", "left_anti"), kept, g.directed), {"nodes_removed": n, "edges_removed": m}


def set_directed(g: PropertyGraph, directed: bool) -> PropertyGraph:
    """M7: undirected to directed keeps each edge's canonical orientation; directed to
    undirected merges mirrored pairs by the rule of ``canonical``."""
    return PropertyGraph(g.vertices, g.edges if directed or not g.directed else canonical(g.edges), directed)


def clear(g: PropertyGraph) -> PropertyGraph:
    """M8: an empty graph of the same direction."""
    return PropertyGraph(g.vertices.limit(0), g.edges.limit(0), g.directed)


def set_node_meta(g: PropertyGraph, node: str, key: str, value) -> PropertyGraph:
    """M9: sets one key of a node."""
    need_key(key)
    g.require(node=node)
    return PropertyGraph(g.vertices.withColumn("meta", F.when(F.col("id") == node, M.put(F.col("meta"), key, value)).otherwise(F.col("meta"))), g.edges, g.directed)


def delete_node_meta(g: PropertyGraph, node: str, key: str) -> PropertyGraph:
    need_key(key)
    g.require(node=node)
    return PropertyGraph(g.vertices.withColumn("meta", F.when(F.col("id") == node, M.drop(F.col("meta"), key)).otherwise(F.col("meta"))), g.edges, g.directed)


def set_edge_meta(g: PropertyGraph, src: str, dst: str, key: str, value) -> PropertyGraph:
    return change_edge_meta(g, src, dst, key, lambda m: M.put(m, key, value))


def delete_edge_meta(g: PropertyGraph, src: str, dst: str, key: str) -> PropertyGraph:
    return change_edge_meta(g, src, dst, key, lambda m: M.drop(m, key))


def change_edge_meta(g: PropertyGraph, src: str, dst: str, key: str, change) -> PropertyGraph:
    need_key(key)
    a, b = ends(g, src, dst)
    here = (F.col("src") == a) & (F.col("dst") == b)
    if g.edges.filter(here).limit(1).isEmpty():
        raise GraphError("edge not found")
    return PropertyGraph(g.vertices, g.edges.withColumn("meta", F.when(here, change(F.col("meta"))).otherwise(F.col("meta"))), g.directed)


def need_key(key: str) -> None:
    if not key:
        raise GraphError("key is required")


def folded(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One row for each key, as if the request's rows were applied in turn: the last text that
    is not empty and the last weight that is not null win; ``ops`` keeps set and delete steps."""
    agg = [F.expr(f"max_by({c}, CASE WHEN {c} <> '' THEN at END)").alias(c) for c in texts]
    if "weight" in rows.columns:
        agg.append(F.expr("max_by(weight, CASE WHEN weight IS NOT NULL THEN at END)").alias("weight"))
    agg.append(F.array_sort(F.collect_list(F.struct("at", "meta", "del"))).alias("ops"))
    return rows.groupBy(*keys).agg(*agg)


def applied_meta(old, ops):
    """The metadata map after all set and delete steps, and how many keys they set and deleted."""
    def step(acc, op):
        new = F.coalesce(F.from_json(op["meta"], META), F.expr(M.EMPTY))
        put = F.map_concat(F.map_filter(acc["m"], lambda k, _: ~F.map_contains_key(new, k)), new)
        gone = F.size(F.map_filter(put, lambda k, _: F.coalesce(F.array_contains(op["del"], k), F.lit(False))))
        kept = F.map_filter(put, lambda k, _: ~F.coalesce(F.array_contains(op["del"], k), F.lit(False)))
        return F.struct(kept.alias("m"), (acc["s"] + F.size(new)).alias("s"), (acc["d"] + gone).alias("d"))

    start = F.struct(F.coalesce(old, F.expr(M.EMPTY)).alias("m"), F.lit(0).alias("s"), F.lit(0).alias("d"))
    return F.aggregate(F.coalesce(ops, F.array().cast("array<struct<at:int,meta:string,del:array<string>>>")), start, step)


def upsert(g: PropertyGraph, nodes: list[dict] = (), edges: list[dict] = ()) -> tuple[PropertyGraph, dict]:
    """M5: batch create or update; nodes first, then edges.

    Rows with an empty id are skipped; empty labels and statuses leave the old ones; a weight
    of 0 differs from none; edges create their missing ends, which count as created. Updates
    count only where something changed, and once for each row of a repeated key at most.
    Metadata is set, then deleted; an updated edge keeps its metadata.
    """
    spark = g.vertices.sparkSession
    n_rows = [(i, r["id"], r.get("label") or "", r.get("status") or "", json.dumps(r.get("meta") or {}), list(r.get("delete") or [])) for i, r in enumerate(nodes) if r.get("id")]
    e_rows = [(i, *ends(g, r["from"], r["to"]), r.get("label") or "", None if r.get("weight") is None else float(r["weight"]), json.dumps(r.get("meta") or {}), list(r.get("delete") or [])) for i, r in enumerate(edges) if r.get("from") and r.get("to")]
    asked = folded(spark.createDataFrame(n_rows, NODE_REQUEST), ["id"], ["label", "status"])
    links = folded(spark.createDataFrame(e_rows, EDGE_REQUEST), ["src", "dst"], ["label"])

    o, n = g.vertices.alias("o"), asked.alias("n")
    v = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    made = F.col("o.id").isNull()

    def text(c: str, side: str = "o"):
        return F.coalesce(f"n.{c}", f"{side}.{c}", F.lit(""))

    changed = ~made & ((text("label") != F.col("o.label")) | (text("status") != F.col("o.status")))
    m = applied_meta(F.col("o.meta"), F.col("n.ops"))
    v = cut(v.select(F.coalesce("o.id", "n.id").alias("id"), text("label").alias("label"), text("status").alias("status"), m.alias("_m"), F.col("o.meta_schema").alias("meta_schema"), made.alias("_new"), F.coalesce(changed, F.lit(False)).alias("_up")))

    o, n = g.edges.alias("o"), links.alias("n")
    e = o.join(n, (F.col("o.src") == F.col("n.src")) & (F.col("o.dst") == F.col("n.dst")), "full_outer")
    made = F.col("o.src").isNull()
    weight = F.coalesce("n.weight", "o.weight", F.lit(0.0))
    changed = ~made & ((weight != F.col("o.weight")) | (text("label") != F.col("o.label")))
    m = applied_meta(F.col("o.meta"), F.col("n.ops"))
    e = cut(e.select(F.coalesce("o.src", "n.src").alias("src"), F.coalesce("o.dst", "n.dst").alias("dst"), weight.alias("weight"), text("label").alias("label"), m.alias("_m"), F.col("o.meta_schema").alias("meta_schema"), made.alias("_new"), F.coalesce(changed, F.lit(False)).alias("_up")))

    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(v.select("id"), "id", "left_anti")
    vertices = v.select("id", "label", "status", F.col("_m.m").alias("meta"), "meta_schema").unionByName(PropertyGraph.of(ids, g.edges.limit(0)).vertices.select(VERTEX_COLUMNS))
    counts = v.agg(*counters("nodes")).first().asDict()
    more = e.agg(*counters("edges")).first().asDict()
    result = {k: int(counts.get(k) or 0) + int(more.get(k) or 0) for k in ("nodes_created", "nodes_updated", "edges_created", "edges_updated", "meta_keys_set", "meta_keys_deleted")}
    result["nodes_created"] += ids.count()
    out = PropertyGraph(vertices, e.select("src", "dst", "weight", "label", F.col("_m.m").alias("meta"), "meta_schema").select(EDGE_COLUMNS), g.directed)
    return out, result


def counters(what: str):
    return [
        F.count_if("_new").alias(f"{what}_created"),
        F.count_if("_up").alias(f"{what}_updated"),
        F.sum("_m.s").alias("meta_keys_set"),
        F.sum("_m.d").alias("meta_keys_deleted"),
    ]
