"""Connected and strongly connected components, spanning forests and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.graph import GraphError, PropertyGraph
from lattica.plans.scratch import cut


def stars(pairs: DataFrame) -> DataFrame:
    """(id, root): the least id that each end of a pair is linked to.

    Alternating large-star and small-star rounds: edges are re-hung on the smallest
    neighbour until every tree is a star, in a logarithmic number of rounds.
    """
    now = cut(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(top, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = cut(small.union(top.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def connected(g: PropertyGraph) -> DataFrame:
    """(id, component): weak components named by their least id, isolated nodes alone."""
    roots = stars(g.edges.select("src", "dst"))
    return g.vertices.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def strongly_connected(g: PropertyGraph) -> DataFrame:
    """(id, component): strong components named by their least id; C1 if undirected.

    Nodes without a way in or out are alone and go first. Then every node takes the least
    id that reaches it as its colour, and what reaches back to the colour's node within the
    colour is one component. Both repeat on what is left.
    """
    if not g.directed:
        return connected(g)
    live = cut(g.vertices.select("id"))
    arcs = cut(g.edges.filter("src <> dst").select("src", "dst").distinct())
    out = []
    while not live.isEmpty():
        while True:  # trim
            inner = arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))
            alone = cut(live.join(inner, "id", "left_anti"))
            if alone.isEmpty():
                break
            out.append(alone.select("id", F.col("id").alias("component")))
            live = cut(live.join(inner, "id", "left_semi"))
            arcs = cut(arcs.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if live.isEmpty():
            break
        colour = live.select("id", F.col("id").alias("c"))
        changed = colour
        while True:
            offers = arcs.join(changed.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("o"))
            state = cut(colour.join(offers, "id", "left").select("id", F.least("c", "o").alias("c"), F.coalesce(F.col("o") < F.col("c"), F.lit(False)).alias("up")))
            colour, changed = state.select("id", "c"), state.filter("up").select("id", "c")
            if changed.isEmpty():
                break
        inside = cut(arcs.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select("src", "dst"))
        found = cut(colour.filter("id = c"))
        front = found
        while True:
            back = inside.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(found.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.union(front))
        out.append(found.select("id", F.col("c").alias("component")))
        live = cut(live.join(found, "id", "left_anti"))
        arcs = cut(arcs.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    whole = g.vertices.sparkSession.createDataFrame([], "id string, component string")
    for part in out:
        whole = whole.union(part)
    return whole


def minimum_spanning_forest(g: PropertyGraph) -> DataFrame:
    """(src, dst, weight) of the minimum spanning forest under the order (weight, src, dst).

    Boruvka rounds: every component picks its least edge to another one. The order is total,
    so the forest is unique and the same as one built edge by edge.
    """
    if g.directed:
        raise GraphError("a spanning tree needs an undirected graph")
    e = cut(g.edges.filter("src <> dst").select("src", "dst", "weight"))
    comp = cut(g.vertices.select("id", F.col("id").alias("c")))
    chosen = cut(e.limit(0))
    while True:
        ends = e.join(comp.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b")
        pick = F.struct("weight", "src", "dst", "a", "b")
        sides = ends.select(F.col("a").alias("c"), pick.alias("p")).union(ends.select(F.col("b").alias("c"), pick.alias("p")))
        best = cut(sides.groupBy("c").agg(F.min("p").alias("p")).select("p.*").distinct())
        if best.isEmpty():
            return chosen.orderBy("weight", "src", "dst")
        chosen = cut(chosen.union(best.select("src", "dst", "weight")))
        roots = stars(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "c")
        comp = cut(comp.join(roots, "c", "left").select("id", F.coalesce("root", "c").alias("c")))


def validate(g: PropertyGraph) -> DataFrame:
    """(type, message, src, dst) of broken rules, by (type, message): edges whose ends
    are missing, repeated keys, undirected edges not in canonical order."""
    ids = g.vertices.select("id").distinct()

    def dangling(end: str, word: str) -> DataFrame:
        bad = g.edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        return bad.select(F.lit("dangling_edge").alias("type"), F.format_string(f'edge {word} "%s" not in nodes', F.col(end)).alias("message"), "src", "dst")

    nodes = g.vertices.groupBy("id").count().filter("count > 1").select(F.lit("count_mismatch").alias("type"), F.format_string('node "%s" occurs %d times', F.col("id"), F.col("count")).alias("message"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    pairs = g.edges.groupBy("src", "dst").count().filter("count > 1").select(F.lit("count_mismatch").alias("type"), F.format_string('edge "%s"->"%s" occurs %d times', F.col("src"), F.col("dst"), F.col("count")).alias("message"), "src", "dst")
    out = dangling("src", "source").union(dangling("dst", "target")).union(nodes).union(pairs)
    if not g.directed:
        out = out.union(g.edges.filter("src > dst").select(F.lit("inconsistent_in_out").alias("type"), F.format_string('edge "%s"->"%s" is not in canonical order', F.col("src"), F.col("dst")).alias("message"), "src", "dst"))
    return out.orderBy("type", "message")
