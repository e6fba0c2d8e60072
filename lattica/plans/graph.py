"""The property graph: a vertex table, an edge table and a direction."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.scratch import cut

META = "map<string,variant>"
SCHEMA_MAP = "map<string,struct<type:string,required:boolean>>"
VERTEX_COLUMNS = ["id", "label", "status", "meta", "meta_schema"]
EDGE_COLUMNS = ["src", "dst", "weight", "label", "meta", "meta_schema"]
DEFAULTS = {"label": "''", "status": "''", "weight": "0D", "meta": f"CAST(map() AS {META})", "meta_schema": f"CAST(NULL AS {SCHEMA_MAP})"}


class GraphError(ValueError):
    """A query that the graph cannot answer: a missing node, a cycle, the wrong direction."""


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the standard columns that are missing; nulls become their defaults."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.expr(DEFAULTS[c]))
        elif c in ("label", "status", "weight", "meta"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.expr(DEFAULTS[c])))
    return df


@dataclass(frozen=True)
class PropertyGraph:
    """vertices: id plus payload; edges: src, dst, weight plus payload, one row per pair.

    An undirected edge is stored once with src <= dst. ``arcs`` is the view that traversals
    use: both directions of undirected edges, self-loops once.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, directed: bool = True) -> PropertyGraph:
        """Standard columns added, ids as strings, undirected edges canonical."""
        vertices = complete(vertices.withColumn("id", F.col("id").cast("string")), VERTEX_COLUMNS)
        edges = edges.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
        if "weight" in edges.columns:
            edges = edges.withColumn("weight", F.col("weight").cast("double"))
        edges = complete(edges, EDGE_COLUMNS)
        return cls(vertices, edges if directed else canonical(edges), directed)

    @classmethod
    def build(cls, spark: SparkSession, nodes: Iterable = (), edges: Iterable = (), directed: bool = True) -> PropertyGraph:
        """From small Python rows: nodes are ids or dicts (id, label, status, meta), edges are
        (src, dst[, weight]) or dicts. Later rows of one key replace earlier ones; an edge to
        an unknown node or an empty id is an error."""
        ns: dict[str, dict] = {}
        for n in nodes:
            row = dict(n) if isinstance(n, dict) else {"id": n}
            ns[row["id"]] = row
        es: dict[tuple[str, str], dict] = {}
        for e in edges:
            row = dict(e) if isinstance(e, dict) else dict(zip(("src", "dst", "weight"), e))
            ends = (row["src"], row["dst"])
            if not directed:
                ends = min(ends), max(ends)
            missing = [x for x in ends if x not in ns]
            if missing:
                raise GraphError(f"node {missing[0]} not found")
            es[ends] = row | {"src": ends[0], "dst": ends[1]}
        if any(not i for i in ns):
            raise GraphError("empty node id")
        v = [(r["id"], r.get("label") or "", r.get("status") or "", json.dumps(r.get("meta") or {}), json.dumps(r.get("schema"))) for r in ns.values()]
        e = [(r["src"], r["dst"], float(r.get("weight") or 0), r.get("label") or "", json.dumps(r.get("meta") or {}), json.dumps(r.get("schema"))) for r in es.values()]
        parse = {"meta": f"from_json(meta, '{META}')", "meta_schema": f"from_json(meta_schema, '{SCHEMA_MAP}')"}
        vertices = spark.createDataFrame(v, "id string, label string, status string, meta string, meta_schema string")
        links = spark.createDataFrame(e, "src string, dst string, weight double, label string, meta string, meta_schema string")
        for c, x in parse.items():
            vertices, links = vertices.withColumn(c, F.expr(x)), links.withColumn(c, F.expr(x))
        return cls(vertices, links, directed)

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = True) -> PropertyGraph:
        return cls.build(spark, directed=directed)

    def arcs(self) -> DataFrame:
        """(src, dst, weight) in every direction an edge can be walked."""
        e = self.edges.select("src", "dst", "weight")
        return e if self.directed else e.union(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def links(self) -> DataFrame:
        """(src, dst) both ways whatever the direction, distinct, without self-loops."""
        e = self.edges.filter("src <> dst").select("src", "dst")
        return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def reverse(self) -> PropertyGraph:
        swapped = self.edges.withColumnsRenamed({"src": "_s"}).withColumnsRenamed({"dst": "src", "_s": "dst"})
        return PropertyGraph(self.vertices, swapped, True) if self.directed else self

    def materialize(self) -> PropertyGraph:
        """Both tables checkpointed, for use by several loops."""
        return PropertyGraph(cut(self.vertices), cut(self.edges), self.directed)

    def has(self, node: str) -> bool:
        return not self.vertices.filter(F.col("id") == node).limit(1).isEmpty()

    def require(self, **nodes: str) -> None:
        """Raises for the first named node that is missing: require(source="a")."""
        for role, node in nodes.items():
            if not self.has(node):
                raise GraphError(f"{role} node not found" if role != "node" else "node not found")

    def need_directed(self, what: str) -> None:
        if not self.directed:
            raise GraphError(f"{what} needs a directed graph")

    def order(self) -> int:
        return self.vertices.count()

    def size(self) -> int:
        """Edges, each undirected one and each self-loop counted once."""
        return self.edges.count()

    def views(self, name: str) -> None:
        """Registers <name>_vertices and <name>_edges for plain SQL."""
        self.vertices.createOrReplaceTempView(f"{name}_vertices")
        self.edges.createOrReplaceTempView(f"{name}_edges")


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges with src <= dst, one row per pair: the row of the greatest weight,
    then of the smallest label, wins."""
    flipped = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    pick = F.max_by(F.struct(*rest), F.struct("weight", F.expr("-length(label)"), "src"))
    one = flipped.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(pick.alias("_r"))
    return one.select("src", "dst", *[F.col(f"_r.{c}").alias(c) for c in rest])
