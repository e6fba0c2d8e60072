"""Further registered queries: whole graphs without a cut, changes, tasks, reads that no other query has."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lattica.functions.filters import matches
from lattica.functions import meta as M
from lattica.operators import explain as E
from lattica.operators import kernels as K
from lattica.operators import lookup as L
from lattica.operators import mutate as U
from lattica.operators import rank as R
from lattica.operators import tasks as J
from lattica.operators import traverse as T
from lattica.operators.compare import diff
from lattica.plans.graph import PropertyGraph
from lattica.queries import BUYERS, CHAIN, FK, HANDOFF, MINPLUS, SHIP, TRADE, WAITS, one_row, query, side, six
from lattica.sources import snapshot
from lattica.sources import tables as G

WHOLE = SHIP + ", v AS (SELECT 'N:' || n_nationkey AS id FROM nation), e AS (SELECT * FROM ship)"
NATIONS = "SELECT 'N:' || n_nationkey AS id, n_name AS label, '' AS status FROM nation"


@query("graph_in_edges_whole", f"WITH {WHOLE} SELECT * FROM e WHERE dst = 'N:1'")
def in_edges_whole(spark, d):
    return L.in_edges(G.trade(spark, d, None), "N:1").select("src", "dst", "weight")


@query("graph_in_edges_buyers", f"WITH {BUYERS} SELECT * FROM e WHERE dst = 'S:1'")
def in_edges_buyers(spark, d):
    return L.in_edges(G.buyers(spark, d), "S:1").select("src", "dst", "weight")


@query("graph_ancestors_order", f"WITH RECURSIVE {FK}, o AS (SELECT 'O:' || min(o_orderkey) AS id FROM orders), t AS (SELECT src AS id FROM fk_e JOIN o ON dst = o.id UNION SELECT src FROM t JOIN fk_e ON dst = t.id) SELECT id FROM t")
def ancestors_order(spark, d):
    first = G.read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    return T.ancestors(G.foreign_keys(spark, d), f"O:{first}")


@query("graph_closure_keys", f"WITH RECURSIVE {FK}, reach AS (SELECT src, dst FROM fk_e UNION SELECT r.src, e.dst FROM reach r JOIN fk_e e ON r.dst = e.src) SELECT src, dst FROM reach")
def closure_keys(spark, d):
    return T.transitive_closure(G.foreign_keys(spark, d)).edges.select("src", "dst")


@query("graph_distances_keys", f"WITH RECURSIVE {FK}, t AS (SELECT 'R:0' AS id, CAST(0 AS DOUBLE) AS dist UNION ALL SELECT dst, dist + length(dst) FROM t JOIN fk_e ON src = id) SELECT id, dist FROM t")
def distances_keys(spark, d):
    g = G.foreign_keys(spark, d)
    return T.distances(PropertyGraph(g.vertices, g.edges.withColumn("weight", F.length("dst").cast("double")), True), "R:0").select("id", "dist")


@query("graph_next_hop", f"WITH RECURSIVE {WHOLE}, {MINPLUS}, w AS (SELECT 0 AS k, id AS src, id AS dst, CAST(0 AS DOUBLE) AS dist FROM v UNION ALL SELECT k + 1, w.src, s.dst, min(dist + s.weight) FROM w JOIN step s ON w.dst = s.src WHERE k < 25 GROUP BY 1, 2, 3), p AS (SELECT src, dst, dist FROM w WHERE k = 25) SELECT p.src, p.dst, p.dist, min(e.dst) AS next FROM p LEFT JOIN (e JOIN p r ON r.src = e.dst) ON p.src <> p.dst AND e.src = p.src AND r.dst = p.dst AND e.weight + r.dist = p.dist GROUP BY 1, 2, 3")
def next_hop(spark, d):
    return T.all_pairs(G.trade(spark, d, None))


@query("graph_rebuilt_path", f"WITH RECURSIVE {WHOLE}, a AS (SELECT src, dst, weight FROM e UNION ALL SELECT id, id, 0.0 FROM v), w AS (SELECT 0 AS k, 'N:0' AS id, CAST(0 AS DOUBLE) AS dist UNION ALL SELECT k + 1, a.dst, min(dist + a.weight) FROM w JOIN a ON w.id = a.src WHERE k < 25 GROUP BY 1, 2) SELECT dist AS cost, true AS walks FROM w WHERE k = 25 AND id = 'N:7'")
def rebuilt_path(spark, d):
    g = G.trade(spark, d, None).materialize()
    path = T.reconstruct_path(T.all_pairs(g).cache(), "N:0", "N:7")
    steps = spark.createDataFrame(list(zip(path, path[1:])), "src string, dst string").join(g.edges, ["src", "dst"])
    return steps.agg(F.sum("weight").alias("cost"), (F.count("*") == len(path) - 1).alias("walks"))


@query("graph_topological_order", "WITH t AS (SELECT DISTINCT conv_id, turn, printf('T:%d:%d', conv_id, turn) AS id FROM conversations), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM t), m AS (SELECT *, max(id) OVER (PARTITION BY conv_id, chain ORDER BY turn ROWS UNBOUNDED PRECEDING) AS top FROM g) SELECT id, row_number() OVER (ORDER BY top, turn) - 1 AS ord FROM m")
def topological_order(spark, d):
    """Of chains: a node follows at once what is greater and before it in its chain."""
    return K.topological_sort(G.turns(spark, d))


@query("graph_flow_of_keys", "SELECT CAST(count(*) AS DOUBLE) AS max_flow FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def flow_of_keys(spark, d):
    """From a nation to a sink behind its customers' orders: as many units as orders, since
    every edge to a customer has room for them."""
    c, o = G.read(spark, d, "customer").filter("c_nationkey = 3"), G.read(spark, d, "orders")
    mine = o.join(c, o.o_custkey == c.c_custkey, "left_semi")
    customer, order = G.tagged("C", "o_custkey"), G.tagged("O", "o_orderkey")
    edges = mine.groupBy(customer.alias("dst")).agg(F.count("*").cast("double").alias("weight")).select(F.lit("N:3").alias("src"), "dst", "weight")
    edges = edges.union(mine.select(customer, order, F.lit(1.0))).union(mine.select(order, F.lit("sink"), F.lit(1.0)))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return spark.createDataFrame([(K.max_flow(PropertyGraph.of(ids, edges), "N:3", "sink")[0],)], "max_flow double")


@query("graph_dfs_stop", f"""WITH RECURSIVE {FK}, t AS (SELECT id, ['N:3'] AS path FROM fk_v WHERE id = 'N:3' UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN fk_e ON src = id), o AS (SELECT id, row_number() OVER (ORDER BY path) - 1 AS ord FROM t)
 SELECT * FROM o WHERE ord <= (SELECT min(ord) FROM o WHERE id LIKE 'O:%7')""")
def dfs_stop(spark, d):
    return K.dfs(G.foreign_keys(spark, d), "N:3", F.col("id").like("O:%7"))


@query("graph_closeness_keys", f"WITH RECURSIVE {FK}, t AS (SELECT id AS s, id, 0 AS d FROM fk_v WHERE id LIKE 'N:%' UNION ALL SELECT s, dst, d + 1 FROM t JOIN fk_e ON src = id) SELECT s AS id, round(coalesce(sum(CASE WHEN d > 0 THEN 1 END) / sum(d), 0), 6) AS score FROM t GROUP BY 1")
def closeness_keys(spark, d):
    g = G.foreign_keys(spark, d)
    return R.closeness(g, g.vertices.filter("id LIKE 'N:%'")).select("id", six("score"))


@query("graph_pagerank_handoff", f"""WITH RECURSIVE {HANDOFF}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), z AS (SELECT count(*) AS z FROM v WHERE id NOT IN (SELECT src FROM e)),
 m AS (SELECT e.src, e.dst, 1.0 / k AS p FROM e JOIN o USING (src) UNION ALL SELECT a.id, b.id, 1.0 / n FROM v a, v b, n WHERE a.id NOT IN (SELECT src FROM e) UNION ALL SELECT id, id, 0.0 FROM v),
 pr AS (SELECT 0 AS i, id, 1.0 / n AS r FROM v, n UNION ALL SELECT i + 1, m.dst, 0.15 / any_value(n) + 0.85 * sum(r * p) FROM pr JOIN m ON pr.id = m.src, n WHERE i < 60 GROUP BY 1, 2)
 SELECT id, round(r, 6) AS score FROM pr WHERE i = 60""")
def pagerank_handoff(spark, d):
    return R.pagerank(G.handoff(spark, d), tolerance=1e-10)[0].select("id", six("score"))


@query("graph_diff_nodes", f"WITH {side('A', 'a')}, {side('R', 'b')}, x AS (SELECT src AS id FROM a UNION SELECT dst FROM a), y AS (SELECT src AS id FROM b UNION SELECT dst FROM b) SELECT 'added' AS kind, id FROM y WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'removed', id FROM x WHERE id NOT IN (SELECT id FROM y)")
def diff_nodes(spark, d):
    def sold(flag):
        edges = G.buyers(spark, d, flag).edges
        return PropertyGraph.of(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges)

    x = diff(sold("A"), sold("R"))
    return x["nodes_added"].select(F.lit("added").alias("kind"), "id").union(x["nodes_removed"].select(F.lit("removed"), "id"))


@query("graph_add_nodes", f"WITH x AS ({NATIONS}), y AS (SELECT 'N:' || r_regionkey AS id, r_name AS label, 'new' AS status FROM region UNION ALL SELECT 'R:' || r_regionkey, r_name, '' FROM region) SELECT * FROM y UNION ALL SELECT * FROM x WHERE id NOT IN (SELECT id FROM y)")
def add_nodes(spark, d):
    g = PropertyGraph.of(G.nations(spark, d), spark.createDataFrame([], "src string, dst string, weight double"))
    r = G.read(spark, d, "region")
    rows = r.select(G.tagged("N", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("new").alias("status"))
    return U.add_nodes(g, rows.union(r.select(G.tagged("R", "r_regionkey"), "r_name", F.lit("")))).vertices.select("id", "label", "status")


@query("graph_add_edges", f"WITH {TRADE}, y AS (SELECT src, dst, 2 * weight AS weight FROM ship WHERE src IN ('N:1', 'N:2')) SELECT * FROM y UNION ALL SELECT e.* FROM e ANTI JOIN y ON e.src = y.src AND e.dst = y.dst")
def add_edges(spark, d):
    more = G.trade(spark, d, None).edges.filter("src IN ('N:1', 'N:2')").select("src", "dst", (2 * F.col("weight")).alias("weight"))
    return U.add_edges(G.trade(spark, d), more).edges.select("src", "dst", "weight")


@query("graph_clear", "SELECT CAST(0 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS edges, true AS directed")
def clear(spark, d):
    g = U.clear(G.foreign_keys(spark, d))
    return spark.createDataFrame([(g.order(), g.size(), g.directed)], "nodes long, edges long, directed boolean")


@query("graph_upsert_counts", "SELECT CAST(2 AS BIGINT) AS nodes_created, CAST(2 AS BIGINT) AS nodes_updated, CAST(1 AS BIGINT) AS edges_created, CAST(1 AS BIGINT) AS edges_updated, CAST(3 AS BIGINT) AS meta_keys_set, CAST(1 AS BIGINT) AS meta_keys_deleted FROM nation WHERE n_nationkey = 1")
def upsert_counts(spark, d):
    g = G.trade(spark, d).materialize()
    e = g.edges.orderBy("src", "dst").first()
    nodes = [{"id": "N:1", "label": "First", "meta": {"a": 1, "b": 2}}, {"id": "N:2", "status": "busy"}, {"id": "N:3"}, {"id": "X:1", "meta": {"c": 1}, "delete": ["c"]}, {"id": ""}]
    counts = U.upsert(g, nodes, [{"from": e.src, "to": e.dst, "weight": e.weight + 1}, {"from": "X:1", "to": "X:2"}])[1]
    return one_row(spark, counts, "nodes_created long, nodes_updated long, edges_created long, edges_updated long, meta_keys_set long, meta_keys_deleted long")


@query("graph_edge_meta", f"WITH {WHOLE} SELECT src, dst, CASE WHEN src = 'N:1' AND dst = 'N:2' THEN 'note' ELSE '' END AS keys FROM e")
def edge_meta(spark, d):
    g = U.set_edge_meta(G.trade(spark, d, None), "N:1", "N:2", "note", "x")
    g = U.delete_edge_meta(U.set_edge_meta(g, "N:2", "N:1", "gone", 1), "N:2", "N:1", "gone")
    return g.edges.select("src", "dst", F.coalesce(F.array_join(M.keys(F.col("meta")), ","), F.lit("")).alias("keys"))


@query("graph_filter_ranges", "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_acctbal < 500 AND c_nationkey <= 12")
def filter_ranges(spark, d):
    p = matches({"key": "acctbal", "op": "lt", "value": 500}) & matches({"key": "nation", "op": "lte", "value": 12}) & matches({"key": "nation", "op": "exists"})
    return L.filter_nodes(G.buyers(spark, d), p).select("id")


@query("graph_apply_meta", "SELECT 'N:' || n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'rank,tier' ELSE '' END AS keys FROM nation")
def apply_meta(spark, d):
    told = {"metadata": {"nodes": [{"id": f"N:{i}", "entries": {"tier": "gold", "rank": i}} for i in range(3)] + [{"id": "nowhere", "entries": {"x": 1}}], "edges": []}}
    g = snapshot.apply_meta(json.dumps(told), PropertyGraph.of(G.nations(spark, d), spark.createDataFrame([], "src string, dst string, weight double")))
    return g.vertices.select("id", F.coalesce(F.array_join(M.keys(F.col("meta")), ","), F.lit("")).alias("keys"))


@query("tasks_added", f"WITH {CHAIN} SELECT id, CASE WHEN id = (SELECT min(id) FROM oc) THEN 'pending' ELSE status END AS status FROM oc UNION ALL SELECT 'new', 'pending'")
def tasks_added(spark, d):
    g = G.order_chain(spark, d).materialize()
    first = g.vertices.agg(F.min("id")).first()[0]
    return J.add_dependency(J.add_task(J.add_task(g, "new"), first), "new", first).vertices.select("id", "status")


@query("tasks_step", f"WITH {WAITS[5:]}, r AS (SELECT oc.id FROM oc LEFT JOIN dep USING (id) WHERE status = 'pending' AND coalesce(ok, true)) SELECT oc.id, CASE WHEN oc.id = (SELECT min(id) FROM r) THEN 'running' WHEN r.id IS NOT NULL THEN 'ready' ELSE status END AS status FROM oc LEFT JOIN r USING (id)")
def tasks_step(spark, d):
    g, ready = J.ready(G.order_chain(spark, d))
    g = g.materialize()
    return J.transition_task(g, ready.first().id, "running").vertices.select("id", "status")


@query("tasks_reset", f"WITH {CHAIN} SELECT id, 'pending' AS status FROM oc")
def tasks_reset(spark, d):
    return J.reset(G.order_chain(spark, d)).vertices.select("id", "status")


@query("tasks_set_status", f"WITH {CHAIN}, f AS (SELECT min(id) AS id FROM oc WHERE status = 'running'), s AS (SELECT oc.id, oc.dst, CASE WHEN oc.id = f.id THEN 'done' ELSE oc.status END AS status FROM oc, f), dep AS (SELECT dst AS id, bool_and(status = 'done') AS ok FROM s WHERE dst IS NOT NULL GROUP BY 1) SELECT s.id, CASE WHEN status = 'pending' AND ok THEN 'ready' ELSE status END AS status FROM s LEFT JOIN dep USING (id)")
def tasks_set_status(spark, d):
    g = G.order_chain(spark, d).materialize()
    return J.set_status(g, g.vertices.filter("status = 'running'").agg(F.min("id")).first()[0], "done").vertices.select("id", "status")


@query("graph_explain_steps", "SELECT CAST(1 AS BIGINT) AS hops, 'R:0' AS first, 'N:' || min(n_nationkey) AS last FROM nation WHERE n_regionkey = 0")
def explain_steps(spark, d):
    first = G.read(spark, d, "nation").filter("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
    told = E.explain_path(G.foreign_keys(spark, d), "R:0", f"N:{first}")
    return spark.createDataFrame([(len(told["path"]) - 1, told["path"][0], told["path"][-1])], "hops long, first string, last string")
