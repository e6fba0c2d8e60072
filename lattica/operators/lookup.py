"""Point lookups, neighbourhood scans, predicates, induced subgraphs and paged reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.filters import matches
from lattica.functions.meta import project
from lattica.plans.graph import GraphError, PropertyGraph


def node(g: PropertyGraph, id_: str) -> DataFrame:
    """The node's row, or none."""
    return g.vertices.filter(F.col("id") == id_)


def edge(g: PropertyGraph, src: str, dst: str) -> DataFrame:
    """The edge's row, or none; either orientation of an undirected edge."""
    a, b = (src, dst) if g.directed else (min(src, dst), max(src, dst))
    return g.edges.filter((F.col("src") == a) & (F.col("dst") == b))


def has_edge(g: PropertyGraph, src: str, dst: str) -> bool:
    return not edge(g, src, dst).limit(1).isEmpty()


def neighbors(g: PropertyGraph, id_: str) -> DataFrame:
    """Out-neighbours, ascending; none for an unknown id."""
    return g.arcs().filter(F.col("src") == id_).select(F.col("dst").alias("id")).orderBy("id")


def out_edges(g: PropertyGraph, id_: str) -> DataFrame:
    """(src, dst, weight) leaving the node, by dst."""
    return g.arcs().filter(F.col("src") == id_).orderBy("dst")


def in_edges(g: PropertyGraph, id_: str) -> DataFrame:
    """P5: (src, dst, weight) entering the node, by src."""
    return g.arcs().filter(F.col("dst") == id_).orderBy("src")


def nodes(g: PropertyGraph) -> DataFrame:
    """All nodes by id."""
    return g.vertices.orderBy("id")


def edges(g: PropertyGraph) -> DataFrame:
    """All edges, each undirected one once, by (src, dst)."""
    return g.edges.orderBy("src", "dst")


def filter_nodes(g: PropertyGraph, predicate: Column) -> DataFrame:
    """nodes that satisfy a column predicate, by id."""
    return g.vertices.filter(predicate).orderBy("id")


def filter_edges(g: PropertyGraph, predicate: Column) -> DataFrame:
    """edges that satisfy a column predicate."""
    return g.edges.filter(predicate)


def roots(g: PropertyGraph) -> DataFrame:
    """nodes nothing points to; a self-loop disqualifies."""
    return g.vertices.join(g.arcs().select(F.col("dst").alias("id")).distinct(), "id", "left_anti").orderBy("id")


def leaves(g: PropertyGraph) -> DataFrame:
    """nodes that point to nothing."""
    return g.vertices.join(g.arcs().select(F.col("src").alias("id")).distinct(), "id", "left_anti").orderBy("id")


def subgraph(g: PropertyGraph, ids: DataFrame | list[str]) -> PropertyGraph:
    """the induced subgraph; unknown ids are ignored, metadata goes along."""
    keep = id_frame(g, ids).distinct()
    inner = g.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(g.vertices.join(keep, "id", "left_semi"), inner.select(g.edges.columns), g.directed)


def id_frame(g: PropertyGraph, ids: DataFrame | list[str]) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    return g.vertices.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def degrees(g: PropertyGraph) -> DataFrame:
    """A2: (id, in_degree, out_degree) of every node, zeros included; equal if undirected."""
    ends = g.arcs().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("in_degree", "out_degree")}
    return g.vertices.select("id").join(counted, "id", "left").withColumns(zero)


def read_nodes(g: PropertyGraph, ids: list[str] | None = None, keys: list[str] | None = None, filters: list[dict] | None = None,
               include_edges: bool = False, offset: int = 0, limit: int = 100, compat: bool = False) -> dict:
    """candidates by id list or all, filters joined by AND, sorted, paged, projected.

    Unknown ids drop out, repeated ids repeat; a limit under 1 means 100; an offset past the
    end gives an empty page; a negative one is an error. Edges are induced by the page, not
    by all matches. Returns nodes and edges as DataFrames, total and has_more.
    """
    if offset < 0:
        raise GraphError("offset must not be negative")
    limit = limit if limit > 0 else 100
    rows = g.vertices
    if ids:
        rows = id_frame(g, ids).join(rows, "id")
    tests = [matches(f, compat) for f in filters or []]
    if tests:
        rows = rows.filter(reduce(lambda a, b: a & b, tests))
    total = rows.count()
    page = rows.orderBy("id").offset(min(offset, total)).limit(limit)
    shown = page.join(degrees(subset_arcs(g, page)), "id", "left")
    shown = shown.select("id", "label", "status", project(F.col("meta"), keys).alias("meta"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")]).orderBy("id")
    links = None
    if include_edges:
        links = subgraph(g, page.select("id")).edges.select("src", "dst", "label", "weight", project(F.col("meta"), keys).alias("meta")).orderBy("src", "dst")
    return {"nodes": shown, "edges": links, "total": total, "has_more": offset + limit < total}


def subset_arcs(g: PropertyGraph, page: DataFrame) -> PropertyGraph:
    """The page's nodes with all edges that touch them, so that degrees stay those of the graph."""
    keep = page.select("id").distinct()
    touch = g.arcs()
    out = touch.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "weight")
    into = touch.join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    return PropertyGraph(keep, out.union(into).distinct(), True)
