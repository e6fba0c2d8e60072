"""Named graphs in a folder: Parquet tables and a manifest for each."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.operators import mutate
from lattica.operators.lookup import read_nodes
from lattica.operators.rank import summary
from lattica.operators.tasks import transition
from lattica.plans.graph import GraphError, PropertyGraph
from lattica.sources.snapshot import unmarshal

SAFE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_. -]*")


def checked(name: str) -> str:
    """A name that is one plain path element."""
    if not name.strip():
        raise GraphError("graph name must not be empty")
    if not SAFE.fullmatch(name) or ".." in name:
        raise GraphError(f"invalid graph name {name!r}")
    return name


class GraphCatalog:
    """Graphs by name, opened lazily and kept once opened.

    A save writes new Parquet folders and then swaps the manifest, so a reader sees the old
    graph or the new one. Bare or wrapped JSON documents in the folder open too. All file
    access goes through Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.graphs = spark, folder.rstrip("/"), {}
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.fs_path(self.folder))

    def path(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.fs_path(path))

    def read_text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def write_text(self, path: str, text: str) -> None:
        temp = self.fs_path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.fs_path(path), False)
        if not self.fs.rename(temp, self.fs_path(path)):
            raise OSError(f"cannot write {path}")

    def manifest(self, name: str) -> dict | None:
        path = self.path(name, "manifest.json")
        return json.loads(self.read_text(path)) if self.exists(path) else None

    def stored(self, name: str) -> PropertyGraph | None:
        if m := self.manifest(name):
            read = [self.spark.read.parquet(self.path(name, m["version"], t)) for t in ("vertices", "edges")]
            return PropertyGraph(*read, m["directed"])
        path = self.path(f"{name}.json")
        return unmarshal(self.spark, self.read_text(path)) if self.exists(path) else None

    def open(self, name: str, directed: bool = True, create: bool = True) -> PropertyGraph:
        """Kept, stored or new; ``directed`` matters only for a new graph."""
        checked(name)
        if name not in self.graphs:
            g = self.stored(name)
            if g is None and not create:
                raise GraphError(f"graph {name} not found")
            self.graphs[name] = g if g is not None else PropertyGraph.empty(self.spark, directed)
        return self.graphs[name]

    def put(self, name: str, g: PropertyGraph) -> None:
        self.graphs[checked(name)] = g

    def info(self, name: str) -> dict:
        """A10: name, node_count, edge_count, directed."""
        g = self.open(name)
        return {"name": name, "node_count": g.order(), "edge_count": g.size(), "directed": g.directed}

    def save(self, name: str) -> dict:
        """Stores an opened graph and goes on with the stored tables."""
        if checked(name) not in self.graphs:
            raise GraphError(f"graph {name} is not open")
        g, version = self.graphs[name], f"v-{uuid.uuid4().hex}"
        g.vertices.write.parquet(self.path(name, version, "vertices"))
        g.edges.write.parquet(self.path(name, version, "edges"))
        read = [self.spark.read.parquet(self.path(name, version, t)) for t in ("vertices", "edges")]
        manifest = {"version": version, "directed": g.directed, "node_count": read[0].count(), "edge_count": read[1].count()}
        self.write_text(self.path(name, "manifest.json"), json.dumps(manifest))
        self.graphs[name] = PropertyGraph(*read, g.directed)
        return {"ok": True}

    def list(self) -> list[dict]:
        """All stored or opened graphs by name; what cannot be read is left out."""
        names = set(self.graphs)
        for status in self.fs.listStatus(self.fs_path(self.folder)):
            name = status.getPath().getName()
            names.add(name.removesuffix(".json"))
        out = []
        for name in sorted(names):
            try:
                m = None if name in self.graphs else self.manifest(checked(name))
                out.append({"name": name, **{k: m[k] for k in ("node_count", "edge_count", "directed")}} if m else self.info(name) if name in self.graphs or self.exists(self.path(f"{name}.json")) else None)
            except Exception:  # noqa: BLE001  an unreadable entry is not a graph
                continue
        return [x for x in out if x]

    def delete(self, name: str) -> dict:
        """Forgets a graph and its files; a missing one is fine."""
        self.graphs.pop(checked(name), None)
        for path in (self.path(name), self.path(f"{name}.json")):
            self.fs.delete(self.fs_path(path), True)
        return {"ok": True}

    def summary(self, name: str) -> dict:
        return summary(self.open(name), name)

    def upsert(self, name: str, nodes: list[dict] = (), edges: list[dict] = ()) -> dict:
        g, result = mutate.upsert(self.open(name), nodes, edges)
        self.put(name, g)
        return result

    def remove(self, name: str, nodes: list[str] = (), edges: list[dict] = ()) -> dict:
        g, result = mutate.remove(self.open(name), list(nodes), [(e["from"], e["to"]) for e in edges])
        self.put(name, g)
        return result

    def transition(self, name: str, id_: str, status: str) -> dict:
        g, result = transition(self.open(name), id_, status)
        self.put(name, g)
        return result

    def read_nodes(self, name: str, **request) -> dict:
        """F6 as plain values: nodes, edges, total, has_more."""
        page = read_nodes(self.open(name), **request)
        rows = {k: [json.loads(r[0]) for r in page[k].select(F.to_json(F.struct(*page[k].columns))).collect()] if page[k] is not None else [] for k in ("nodes", "edges")}  # one page
        for e in rows["edges"]:
            e["from"], e["to"] = e.pop("src"), e.pop("dst")
        return {**rows, "total": page["total"], "has_more": page["has_more"]}
