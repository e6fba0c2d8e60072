"""Snapshot documents: the JSON form of one graph, version 1."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import meta as M
from lattica.operators.lookup import id_frame
from lattica.plans.graph import GraphError, PropertyGraph

VERSION = 1
LIMIT = 2_000_000  # rows that one JSON document may hold; larger graphs are saved as Parquet


def document_rows(df: DataFrame, order: list[str]) -> list[dict]:
    """The rows of one JSON document, in order; a document is one driver-side text."""
    n = df.limit(LIMIT + 1).count()
    if n > LIMIT:
        raise GraphError(f"over {LIMIT} rows: save this graph as Parquet")
    body = df.select(*order, F.to_json(F.struct(*df.columns)).alias("_json")).orderBy(*order)
    return [json.loads(r._json) for r in body.collect()]


def marshal(g: PropertyGraph, ids: list[str] | None = None, graph: bool = True, meta: bool = True, schemas: bool = True, indent: bool = True) -> str:
    """The document of a graph or of the subgraph of some ids; sections can be left
    out. Nodes and edges are sorted, undirected edges have from <= to. An owner appears under
    metadata if it has entries or, unlike them, a schema."""
    v, e = g.vertices, g.edges
    if ids is not None:
        keep = id_frame(g, ids).distinct()
        v = v.join(keep, "id", "left_semi")
        e = e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.withColumnsRenamed({"src": "from", "dst": "to"})
    out: dict = {"version": VERSION, "directed": g.directed}
    if graph:
        out["graph"] = {"nodes": document_rows(v.select("id", F.struct("label", "status").alias("data")), ["id"]), "edges": document_rows(e.select("from", "to", F.struct("label").alias("data"), "weight"), ["from", "to"])}
    if meta:
        told = (M.count(F.col("meta")) > 0) | (F.col("meta_schema").isNotNull() if schemas else F.lit(False))
        cols = [F.col("meta").alias("entries")] + ([F.col("meta_schema").alias("schema")] if schemas else [])
        out["metadata"] = {"nodes": document_rows(v.filter(told).select("id", *cols), ["id"]), "edges": document_rows(e.filter(told).select("from", "to", *cols), ["from", "to"])}
    return json.dumps(out, indent=2 if indent else None, sort_keys=True, ensure_ascii=False)


def parse(text: str) -> dict:
    """A snapshot document, bare or wrapped together with positions."""
    try:
        doc = json.loads(text)
    except ValueError as error:
        raise GraphError(f"invalid snapshot: {error}") from error
    return doc["snapshot"] if isinstance(doc, dict) and "snapshot" in doc else doc


def unmarshal(spark: SparkSession, text: str) -> PropertyGraph:
    """The graph of a document. Another version or an edge without its ends is an error;
    metadata of unknown owners is skipped."""
    doc = parse(text)
    if doc.get("version") != VERSION:
        raise GraphError(f"unsupported snapshot version {doc.get('version')}")
    body, told = doc.get("graph") or {}, doc.get("metadata") or {}
    directed = bool(doc.get("directed"))
    nodes = {n["id"]: {"id": n["id"], **(n.get("data") or {})} for n in body.get("nodes") or []}
    edges = {}
    for e in body.get("edges") or []:
        key = (e["from"], e["to"]) if directed else (min(e["from"], e["to"]), max(e["from"], e["to"]))
        edges[key] = {"src": key[0], "dst": key[1], "weight": e.get("weight") or 0, **(e.get("data") or {})}
    for m in told.get("nodes") or []:
        if m["id"] in nodes:
            nodes[m["id"]] |= {"meta": m.get("entries"), "schema": m.get("schema")}
    for m in told.get("edges") or []:
        key = (m["from"], m["to"]) if directed else (min(m["from"], m["to"]), max(m["from"], m["to"]))
        if key in edges:
            edges[key] |= {"meta": m.get("entries"), "schema": m.get("schema")}
    return PropertyGraph.build(spark, nodes.values(), edges.values(), directed)


def apply_meta(text: str, g: PropertyGraph) -> PropertyGraph:
    """Merges a document's metadata into a graph: its keys replace equal ones, its schemas
    replace schemas, unknown owners are skipped. The version is not looked at."""
    told, spark = parse(text).get("metadata") or {}, g.vertices.sparkSession

    def merged(rows: DataFrame, keys: list[str], owners: list[tuple]) -> DataFrame:
        kinds = ", ".join(f"{k} string" for k in keys)
        new = spark.createDataFrame(owners, f"{kinds}, _e string, _s string")
        new = new.withColumn("_e", F.expr("from_json(_e, 'map<string,variant>')")).withColumn("_s", F.expr("from_json(_s, 'map<string,struct<type:string,required:boolean>>')"))
        joined = rows.join(F.broadcast(new), keys, "left")
        entries = F.coalesce("_e", F.expr(M.EMPTY))
        kept = F.map_filter(F.coalesce("meta", F.expr(M.EMPTY)), lambda k, _: ~F.map_contains_key(entries, k))
        return joined.withColumn("meta", F.map_concat(kept, entries)).withColumn("meta_schema", F.coalesce("_s", "meta_schema")).select(rows.columns)

    def texts(m: dict) -> tuple[str, str]:
        return json.dumps(m.get("entries") or {}), json.dumps(m.get("schema"))

    nodes = {m["id"]: (m["id"], *texts(m)) for m in told.get("nodes") or []}
    pairs = {}
    for m in told.get("edges") or []:
        a, b = (m["from"], m["to"]) if g.directed else (min(m["from"], m["to"]), max(m["from"], m["to"]))
        pairs[a, b] = (a, b, *texts(m))
    return PropertyGraph(merged(g.vertices, ["id"], list(nodes.values())), merged(g.edges, ["src", "dst"], list(pairs.values())), g.directed)


def export(g: PropertyGraph, positions: dict[str, dict] | None = None) -> str:
    """The document wrapped with node positions."""
    return json.dumps({"positions": positions or {}, "snapshot": json.loads(marshal(g))}, sort_keys=True)


def import_(spark: SparkSession, text: str, per_row: int = 5) -> tuple[PropertyGraph, dict[str, dict]]:
    """A wrapped or bare document; nodes without a position get a place on a grid."""
    doc, g = json.loads(text), unmarshal(spark, text)
    return g, placed(g, dict(doc.get("positions") or {}) if "snapshot" in doc else {}, per_row)


def placed(g: PropertyGraph, places: dict[str, dict], per_row: int = 5) -> dict[str, dict]:
    """A place for every node of a drawn graph: the given ones, and a grid for the others."""
    ids = [r.id for r in g.vertices.select("id").orderBy("id").collect()]  # as many as a page shows
    grid = {node: {"x": 150.0 + 200.0 * (i % per_row), "y": 80.0 + 150.0 * (i // per_row)} for i, node in enumerate(x for x in ids if x not in places)}
    return {node: places.get(node) or grid[node] for node in ids}
