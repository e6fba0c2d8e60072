"""Registered graph queries over the sample tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import meta as M
from lattica.operators import components as C
from lattica.operators import explain as E
from lattica.operators import kernels as K
from lattica.operators import lookup as L
from lattica.operators import mutate as U
from lattica.operators import rank as R
from lattica.operators import tasks as J
from lattica.operators import traverse as T
from lattica.operators.compare import diff
from lattica.plans.graph import PropertyGraph
from lattica.sources import loaders, snapshot, templates
from lattica.sources import tables as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FK = """fk_v AS (SELECT 'R:' || r_regionkey AS id FROM region UNION ALL SELECT 'N:' || n_nationkey FROM nation UNION ALL SELECT 'C:' || c_custkey FROM customer UNION ALL SELECT 'S:' || s_suppkey FROM supplier UNION ALL SELECT 'O:' || o_orderkey FROM orders),
fk_e AS (SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders)"""
SHIP = """ship AS (SELECT 'N:' || s_nationkey AS src, 'N:' || c_nationkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
TRADE = SHIP + """,
v AS (SELECT 'N:' || n_nationkey AS id FROM nation),
e AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ship) WHERE r <= 3)"""
TRADE_U = SHIP + """,
v AS (SELECT 'N:' || n_nationkey AS id FROM nation),
e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM ship GROUP BY 1, 2)"""
HANDOFF = """ev AS (SELECT 'U:' || user_id AS src, lead('U:' || user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
v AS (SELECT DISTINCT src AS id FROM ev),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM ev WHERE dst IS NOT NULL GROUP BY 1, 2)"""
BUYERS = """e AS (SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
CHAIN = """oc AS (SELECT 'O:' || o_orderkey AS id, o_custkey, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS status,
  lead('O:' || o_orderkey) OVER w AS dst, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) AS DOUBLE) AS days, row_number() OVER w - 1 AS level FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
REACH = "reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)"
DEGREES = "deg AS (SELECT v.id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree FROM v LEFT JOIN (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) o USING (id))"
WALKS = "walks AS (SELECT id AS s, id, 0 AS d, CAST(1 AS DOUBLE) AS c FROM v UNION ALL SELECT w.s, e.dst, w.d + 1, sum(w.c) FROM walks w JOIN e ON w.id = e.src WHERE w.d < 25 GROUP BY 1, 2, 3), sp AS (SELECT s, id, d, c FROM (SELECT *, min(d) OVER (PARTITION BY s, id) AS m FROM walks) WHERE d = m)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def six(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


def one_row(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


@query("graph_degrees", f"WITH {HANDOFF}, {DEGREES} SELECT * FROM deg")
def degrees(spark, d):
    return L.degrees(G.handoff(spark, d))


@query("graph_analytics", f"""WITH RECURSIVE {TRADE}, {DEGREES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 lv AS (SELECT id AS s, id, 0 AS d FROM v UNION SELECT s, dst, d + 1 FROM lv JOIN u ON lv.id = u.src WHERE d < 24), ds AS (SELECT s, id, min(d) AS d FROM lv GROUP BY 1, 2),
 cc AS (SELECT s, min(id) AS c FROM ds GROUP BY 1), n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM v), m AS (SELECT CAST(count(*) AS BIGINT) AS m FROM e), p AS (SELECT CAST(count(DISTINCT c) AS BIGINT) AS p FROM cc)
 SELECT n AS node_count, m AS edge_count, true AS directed, round(m / (n * (n - 1)), 6) AS density, round(m / n, 6) AS avg_degree, (SELECT max(in_degree) FROM deg) AS max_in_degree, (SELECT max(out_degree) FROM deg) AS max_out_degree,
 CAST(CASE WHEN p = 1 THEN (SELECT max(d) FROM ds) ELSE -1 END AS INTEGER) AS diameter, p AS components FROM n, m, p""")
def analytics(spark, d):
    a = R.analytics(G.trade(spark, d))
    return a.withColumns({c: F.round(c, 6) for c in ("density", "avg_degree")})


@query("graph_roots", f"WITH {FK} SELECT id FROM fk_v WHERE id NOT IN (SELECT dst FROM fk_e)")
def roots(spark, d):
    return L.roots(G.foreign_keys(spark, d)).select("id")


@query("graph_leaves", f"WITH {FK} SELECT id FROM fk_v WHERE id NOT IN (SELECT src FROM fk_e)")
def leaves(spark, d):
    return L.leaves(G.foreign_keys(spark, d)).select("id")


@query("graph_node", f"WITH {FK} SELECT id FROM fk_v WHERE id = 'C:7'")
def node(spark, d):
    return L.node(G.foreign_keys(spark, d), "C:7").select("id")


@query("graph_edge", f"WITH {TRADE_U} SELECT src, dst, weight FROM e WHERE src = 'N:1' AND dst = 'N:3'")
def edge(spark, d):
    return L.edge(G.trade_both_ways(spark, d), "N:3", "N:1").select("src", "dst", "weight")


@query("graph_neighbors", f"WITH {FK} SELECT dst AS id FROM fk_e WHERE src = 'N:3'")
def neighbors(spark, d):
    return L.neighbors(G.foreign_keys(spark, d), "N:3")


@query("graph_out_edges", f"WITH {TRADE} SELECT * FROM e WHERE src = 'N:1'")
def out_edges(spark, d):
    return L.out_edges(G.trade(spark, d), "N:1")


@query("graph_in_edges", f"WITH {TRADE} SELECT * FROM e WHERE dst = 'N:1'")
def in_edges(spark, d):
    return L.in_edges(G.trade(spark, d), "N:1")


@query("graph_nodes", f"WITH {FK} SELECT id FROM fk_v")
def nodes(spark, d):
    return L.nodes(G.foreign_keys(spark, d)).select("id")


@query("graph_edges", f"WITH {HANDOFF} SELECT * FROM e")
def edges(spark, d):
    return L.edges(G.handoff(spark, d)).select("src", "dst", "weight")


@query("graph_size", f"WITH {HANDOFF} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges")
def size(spark, d):
    g = G.handoff(spark, d)
    return spark.createDataFrame([(g.order(), g.size())], "nodes long, edges long")


@query("graph_filter_nodes", "SELECT 'C:' || c_custkey AS id, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def filter_nodes(spark, d):
    from lattica.functions.filters import matches

    p = matches({"key": "status", "op": "eq", "value": "BUILDING"}) & matches({"key": "acctbal", "op": "gt", "value": 5000})
    return L.filter_nodes(G.buyers(spark, d), p).select("id", "label")


@query("graph_filter_edges", f"WITH {BUYERS} SELECT * FROM e WHERE weight > 60")
def filter_edges(spark, d):
    return L.filter_edges(G.buyers(spark, d), F.col("weight") > 60).select("src", "dst", "weight")


@query("graph_subgraph", f"WITH {BUYERS} SELECT e.* FROM e JOIN customer ON src = 'C:' || c_custkey JOIN supplier ON dst = 'S:' || s_suppkey WHERE c_nationkey < 5 AND s_nationkey < 5")
def subgraph(spark, d):
    c, s = G.read(spark, d, "customer").filter("c_nationkey < 5"), G.read(spark, d, "supplier").filter("s_nationkey < 5")
    ids = c.select(G.tagged("C", "c_custkey").alias("id")).union(s.select(G.tagged("S", "s_suppkey")))
    return L.subgraph(G.buyers(spark, d), ids).edges.select("src", "dst", "weight")


@query("graph_read_nodes", f"""WITH {BUYERS}, dg AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1),
 m AS (SELECT 'C:' || c_custkey AS id, c_name AS label, c_mktsegment AS status FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 100 AND CAST(c_nationkey AS VARCHAR) LIKE '%1%')
 SELECT id, label, status, CAST(coalesce(n, 0) AS BIGINT) AS in_degree, CAST(coalesce(n, 0) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM m) AS BIGINT) AS total FROM m LEFT JOIN dg USING (id) ORDER BY id LIMIT 40 OFFSET 20""")
def read_nodes(spark, d):
    tests = [{"key": "status", "op": "neq", "value": "BUILDING"}, {"key": "acctbal", "op": "gte", "value": 100}, {"key": "nation", "op": "contains", "value": 1}]
    page = L.read_nodes(G.buyers(spark, d), keys=["nation"], filters=tests, offset=20, limit=40)
    return page["nodes"].drop("meta").withColumn("total", F.lit(page["total"]).cast("long"))


@query("graph_bfs", f"""WITH RECURSIVE {FK}, t AS (SELECT id, ['R:0'] AS path, 0 AS level FROM fk_v WHERE id = 'R:0' UNION ALL SELECT dst, list_append(path, dst), level + 1 FROM t JOIN fk_e ON src = id)
 SELECT id, row_number() OVER (ORDER BY level, path) - 1 AS ord, level FROM t""")
def bfs(spark, d):
    return T.bfs(G.foreign_keys(spark, d), "R:0")


@query("graph_dfs", f"""WITH RECURSIVE {FK}, t AS (SELECT id, ['N:3'] AS path FROM fk_v WHERE id = 'N:3' UNION ALL SELECT dst, list_append(path, dst) FROM t JOIN fk_e ON src = id)
 SELECT id, row_number() OVER (ORDER BY path) - 1 AS ord FROM t""")
def dfs(spark, d):
    return K.dfs(G.foreign_keys(spark, d), "N:3")


@query("graph_descendants", f"WITH RECURSIVE {FK}, t AS (SELECT dst AS id FROM fk_e WHERE src = 'N:3' UNION SELECT dst FROM t JOIN fk_e ON src = id) SELECT id FROM t")
def descendants(spark, d):
    return T.descendants(G.foreign_keys(spark, d), "N:3")


@query("graph_ancestors", f"WITH RECURSIVE {TRADE}, t AS (SELECT src AS id FROM e WHERE dst = 'N:4' UNION SELECT src FROM t JOIN e ON dst = id) SELECT id FROM t")
def ancestors(spark, d):
    return T.ancestors(G.trade(spark, d), "N:4")


@query("graph_closure", f"WITH RECURSIVE {TRADE}, {REACH} SELECT src, dst FROM reach WHERE src <> dst")
def closure(spark, d):
    return T.transitive_closure(G.trade(spark, d)).edges.select("src", "dst")


MINPLUS = "step AS (SELECT src, dst, weight FROM e UNION ALL SELECT id, id, 0.0 FROM v)"


@query("graph_distances", f"WITH RECURSIVE {TRADE}, {MINPLUS}, w AS (SELECT 0 AS k, 'N:0' AS id, CAST(0 AS DOUBLE) AS dist UNION ALL SELECT k + 1, s.dst, min(dist + s.weight) FROM w JOIN step s ON w.id = s.src WHERE k < 25 GROUP BY 1, 2) SELECT id, dist FROM w WHERE k = 25")
def distances(spark, d):
    return T.distances(G.trade(spark, d), "N:0").select("id", "dist")


@query("graph_all_pairs", f"WITH RECURSIVE {TRADE}, {MINPLUS}, w AS (SELECT 0 AS k, id AS src, id AS dst, CAST(0 AS DOUBLE) AS dist FROM v UNION ALL SELECT k + 1, w.src, s.dst, min(dist + s.weight) FROM w JOIN step s ON w.dst = s.src WHERE k < 25 GROUP BY 1, 2, 3) SELECT src, dst, dist FROM w WHERE k = 25")
def all_pairs(spark, d):
    return T.all_pairs(G.trade(spark, d)).select("src", "dst", "dist")


PATH = f"WITH RECURSIVE {TRADE_U}, a AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), w AS (SELECT 0 AS k, 'N:0' AS id, CAST(0 AS DOUBLE) AS d, ['N:0'] AS path UNION ALL SELECT k + 1, s.dst, min(w.d + s.weight), arg_min(CASE WHEN s.src = s.dst THEN path ELSE list_append(path, s.dst) END, w.d + s.weight) FROM w JOIN (SELECT * FROM a UNION ALL SELECT id, id, 0.0 FROM v) s ON w.id = s.src WHERE k < 25 GROUP BY 1, 2)"


@query("graph_shortest_path", PATH + " SELECT array_to_string(path, '>') AS path, d AS cost FROM w WHERE k = 25 AND id = 'N:7'")
def shortest_path(spark, d):
    path, cost = T.shortest_path(G.trade_both_ways(spark, d), "N:0", "N:7")
    return spark.createDataFrame([(">".join(path), cost)], "path string, cost double")


@query("graph_explain_path", PATH + " SELECT printf('There is a path of %d hop(s) from ''N:0'' to ''N:7'' with a total weight of %.2f. The path traverses through %d node(s): %s.', len(path) - 1, d, len(path), array_to_string(path, ' -> ')) AS explanation FROM w WHERE k = 25 AND id = 'N:7'")
def explain_path(spark, d):
    return one_row(spark, E.explain_path(G.trade_both_ways(spark, d), "N:0", "N:7"), "explanation string")


@query("graph_critical_path", f"""WITH {CHAIN}, s AS (SELECT id, coalesce(sum(days) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earliest,
 coalesce(sum(days) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rest FROM oc), l AS (SELECT max(earliest) AS length FROM s)
 SELECT id, earliest, length - rest AS latest, length - rest - earliest AS slack, length - rest = earliest AS critical FROM s, l""")
def critical_path(spark, d):
    return T.critical_path(G.order_chain(spark, d))[0]


@query("graph_topological_levels", f"WITH {CHAIN} SELECT id, CAST(level AS INTEGER) AS level FROM oc")
def topological_levels(spark, d):
    return T.topological_levels(G.order_chain(spark, d))


@query("graph_topological_sort")
def topological_sort(spark, d):
    return K.topological_sort(G.turns(spark, d))


@query("graph_cyclic_core", f"WITH RECURSIVE {TRADE}, {REACH}, c AS (SELECT src AS id FROM reach WHERE src = dst) SELECT src, dst FROM e WHERE (src IN (SELECT id FROM c) OR src IN (SELECT dst FROM reach WHERE src IN (SELECT id FROM c))) AND (dst IN (SELECT id FROM c) OR dst IN (SELECT src FROM reach WHERE dst IN (SELECT id FROM c)))")
def cyclic_core(spark, d):
    return T.cyclic_core(G.trade(spark, d))


@query("graph_cycle_path")
def cycle_path(spark, d):
    return spark.createDataFrame(list(enumerate(K.cycle_path(G.trade(spark, d, None)))), "ord long, id string")


@query("graph_components", f"WITH RECURSIVE {FK}, t AS (SELECT id AS root, id FROM fk_v WHERE id LIKE 'R:%' UNION ALL SELECT root, dst FROM t JOIN fk_e ON src = id), m AS (SELECT root, min(id) AS component FROM t GROUP BY 1) SELECT id, component FROM t JOIN m USING (root)")
def connected(spark, d):
    return C.connected(G.foreign_keys(spark, d))


@query("graph_strong_components", f"WITH RECURSIVE {TRADE}, {REACH}, b AS (SELECT a.src AS id, a.dst AS other FROM reach a JOIN reach z ON a.src = z.dst AND a.dst = z.src UNION SELECT id, id FROM v) SELECT id, min(other) AS component FROM b GROUP BY 1")
def strongly_connected(spark, d):
    return C.strongly_connected(G.trade(spark, d))


@query("graph_spanning_forest", f"""WITH RECURSIVE {TRADE_U}, r AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS k FROM e), a AS (SELECT src, dst, k FROM r UNION ALL SELECT dst, src, k FROM r UNION ALL SELECT id, id, 0 FROM v),
 w AS (SELECT 0 AS i, src, dst, k FROM a UNION ALL SELECT i + 1, w.src, a.dst, min(greatest(w.k, a.k)) FROM w JOIN a ON w.dst = a.src WHERE i < 24 GROUP BY 1, 2, 3)
 SELECT r.src, r.dst, r.weight FROM r JOIN w ON w.src = r.src AND w.dst = r.dst AND w.i = 24 WHERE w.k = r.k""")
def spanning_forest(spark, d):
    return C.minimum_spanning_forest(G.trade_both_ways(spark, d))


@query("graph_validate", """SELECT 'dangling_edge' AS type, 'edge target "O:' || o_orderkey || '" not in nodes' AS message, 'C:' || o_custkey AS src, 'O:' || o_orderkey AS dst FROM orders WHERE o_orderstatus = 'P'""")
def validate(spark, d):
    g = G.foreign_keys(spark, d)
    gone = G.read(spark, d, "orders").filter("o_orderstatus = 'P'").select(G.tagged("O", "o_orderkey").alias("id"))
    return C.validate(PropertyGraph(g.vertices.join(gone, "id", "left_anti"), g.edges, True))


@query("graph_degree_centrality", f"WITH {HANDOFF}, {DEGREES} SELECT id, round(out_degree / ((SELECT count(*) FROM v) - 1), 6) AS score FROM deg")
def degree_centrality(spark, d):
    return R.degree_centrality(G.handoff(spark, d)).select("id", six("score"))


@query("graph_ranking", f"WITH {HANDOFF}, {DEGREES} SELECT id, row_number() OVER (ORDER BY out_degree DESC, id) AS rank FROM deg")
def ranking(spark, d):
    return R.ranking(R.degree_centrality(G.handoff(spark, d))).select("id", "rank")


@query("graph_closeness", f"WITH RECURSIVE {TRADE}, {WALKS} SELECT v.id, round(coalesce(count(sp.id) / sum(sp.d), 0), 6) AS score FROM v LEFT JOIN sp ON sp.s = v.id AND sp.d > 0 GROUP BY 1")
def closeness(spark, d):
    return R.closeness(G.trade(spark, d)).select("id", six("score"))


@query("graph_betweenness", f"""WITH RECURSIVE {TRADE}, {WALKS}, b AS (SELECT a.id, sum(a.c * z.c / t.c) AS x FROM sp a JOIN sp z ON a.id = z.s JOIN sp t ON t.s = a.s AND t.id = z.id AND t.d = a.d + z.d WHERE a.id <> a.s AND z.id <> a.id AND a.s <> z.id GROUP BY 1)
 SELECT v.id, round(coalesce(x, 0), 6) AS score FROM v LEFT JOIN b USING (id)""")
def betweenness(spark, d):
    return R.betweenness(G.trade(spark, d)).select("id", six("score"))


RANKS = f"""WITH RECURSIVE {TRADE}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS k FROM e GROUP BY 1),
 m AS (SELECT e.src, e.dst, 1.0 / k AS p FROM e JOIN o USING (src) UNION ALL SELECT a.id, b.id, 1.0 / n FROM v a, v b, n WHERE a.id NOT IN (SELECT src FROM e) UNION ALL SELECT id, id, 0.0 FROM v),
 pr AS (SELECT 0 AS i, id, 1.0 / n AS r FROM v, n UNION ALL SELECT i + 1, m.dst, 0.15 / any_value(n) + 0.85 * sum(r * p) FROM pr JOIN m ON pr.id = m.src, n WHERE i < 15 GROUP BY 1, 2)"""


@query("graph_pagerank", RANKS + " SELECT id, round(r, 6) AS score FROM pr WHERE i = 15")
def pagerank(spark, d):
    return R.pagerank(G.trade(spark, d), max_iter=15, tolerance=0.0)[0].select("id", six("score"))


@query("graph_max_flow")
def max_flow(spark, d):
    value, _, cut = K.max_flow(G.trade(spark, d, None), "N:0", "N:7")
    return cut.withColumn("max_flow", F.lit(value))


@query("graph_simple_paths", f"WITH RECURSIVE {TRADE}, p AS (SELECT ['N:0'] AS path, 'N:0' AS id UNION ALL SELECT list_append(path, dst), dst FROM p JOIN e ON src = id WHERE id <> 'N:7' AND len(path) <= 10 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM p WHERE id = 'N:7' ORDER BY path LIMIT 5)")
def simple_paths(spark, d):
    return T.simple_paths(G.trade(spark, d), "N:0", "N:7").select(F.array_join("path", ">").alias("path"))


@query("graph_explain_centrality", f"""WITH {HANDOFF}, {DEGREES}, r AS (SELECT id, out_degree, row_number() OVER (ORDER BY out_degree DESC, id) AS rank, count(*) OVER () AS n FROM deg)
 SELECT rank, printf('Node ''%s'' is ranked #%d out of %d nodes by degree centrality with a score of %.4f.', id, rank, n, out_degree / (n - 1)) AS explanation FROM r WHERE id = 'U:1'""")
def explain_centrality(spark, d):
    return one_row(spark, E.explain_centrality(G.handoff(spark, d).materialize(), "U:1"), "rank long, explanation string")


@query("graph_explain_component", f"""WITH RECURSIVE {TRADE}, {REACH}, b AS (SELECT a.src AS id, a.dst AS other FROM reach a JOIN reach z ON a.src = z.dst AND a.dst = z.src UNION SELECT id, id FROM v), c AS (SELECT id, min(other) AS c FROM b GROUP BY 1), k AS (SELECT c, CAST(dense_rank() OVER (ORDER BY c) AS BIGINT) AS component_id, id FROM c)
 SELECT component_id, CAST((SELECT count(*) FROM k b WHERE b.c = k.c) AS BIGINT) AS component_size FROM k WHERE id = 'N:4'""")
def explain_component(spark, d):
    return one_row(spark, E.explain_component(G.trade(spark, d), "N:4"), "component_id long, component_size long")


@query("graph_explain_dependency", "SELECT true AS is_direct, true AS is_transitive, '''R:0'' has a direct dependency on ''N:' || min(n_nationkey) || ''' via a single edge.' AS explanation FROM nation WHERE n_regionkey = 0")
def explain_dependency(spark, d):
    first = G.read(spark, d, "nation").filter("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
    return one_row(spark, E.explain_dependency(G.foreign_keys(spark, d), "R:0", f"N:{first}"), "is_direct boolean, is_transitive boolean, explanation string")


def side(flag: str, name: str) -> str:
    return f"{name} AS (SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{flag}' GROUP BY 1, 2)"


@query("graph_diff", f"WITH {side('A', 'a')}, {side('R', 'b')} SELECT CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.weight AS old_weight, b.weight AS new_weight FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst WHERE a.weight IS DISTINCT FROM b.weight")
def differences(spark, d):
    x = diff(G.buyers(spark, d, "A"), G.buyers(spark, d, "R"))
    none = F.lit(None).cast("double")
    parts = [("added", x["edges_added"].select("src", "dst", none.alias("old_weight"), F.col("weight").alias("new_weight"))), ("removed", x["edges_removed"].select("src", "dst", F.col("weight").alias("old_weight"), none.alias("new_weight"))), ("changed", x["weights_changed"])]
    frames = [f.select(F.lit(k).alias("kind"), "src", "dst", "old_weight", "new_weight") for k, f in parts]
    return frames[0].union(frames[1]).union(frames[2])


@query("graph_upsert", "SELECT 'N:' || n_nationkey AS id, CASE n_nationkey WHEN 1 THEN 'First' ELSE n_name END AS label, CASE n_nationkey WHEN 2 THEN 'busy' ELSE '' END AS status FROM nation UNION ALL SELECT 'X:1', 'New', '' UNION ALL SELECT 'X:2', '', ''")
def upsert(spark, d):
    g = PropertyGraph.of(G.nations(spark, d), spark.createDataFrame([], "src string, dst string, weight double"))
    out, _ = U.upsert(g, [{"id": "N:1", "label": "First"}, {"id": "N:2", "status": "busy"}, {"id": "X:1", "label": "New"}, {"id": ""}], [{"from": "X:1", "to": "X:2", "weight": 2}])
    return out.vertices.select("id", "label", "status")


@query("graph_remove", f"WITH {FK} SELECT src, dst FROM fk_e WHERE src NOT IN ('N:3', 'R:1') AND dst NOT IN ('N:3', 'R:1') AND NOT (src = 'N:4' AND dst LIKE 'C:%4')")
def removed(spark, d):
    g = G.foreign_keys(spark, d)
    pairs = [("N:4", r.dst) for r in g.edges.filter("src = 'N:4' AND dst LIKE 'C:%4'").select("dst").collect()]
    return U.remove(g, ["N:3", "R:1", "nowhere"], pairs)[0].edges.select("src", "dst")


@query("graph_set_directed", f"WITH {HANDOFF} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM e GROUP BY 1, 2")
def set_directed(spark, d):
    return U.set_directed(G.handoff(spark, d), False).edges.select("src", "dst", "weight")


@query("graph_meta_page", "SELECT 'C:' || c_custkey AS id, 'acctbal' AS key, CAST(2 AS INTEGER) AS total, true AS has_more FROM customer")
def meta_page(spark, d):
    page = M.page(F.col("meta"), 0, 1)
    rows = G.buyers(spark, d).vertices.filter("id LIKE 'C:%'").select("id", page.alias("p"))
    return rows.select("id", F.col("p.items")[0]["key"].alias("key"), "p.total", "p.has_more")


@query("graph_meta_put", "SELECT 'C:' || c_custkey AS id, 'acctbal,nation,tier' AS keys, CAST(3 AS INTEGER) AS n FROM customer")
def meta_put(spark, d):
    new = M.put(F.col("meta"), "tier", "gold")
    rows = G.buyers(spark, d).vertices.filter("id LIKE 'C:%'").select("id", new.alias("m"))
    return rows.select("id", F.array_join(M.keys(F.col("m")), ",").alias("keys"), M.count(F.col("m")).alias("n"))


@query("graph_schema_errors", """SELECT 'C:' || c_custkey AS id, 'nation' AS key, 'field "nation": expected type string, got BIGINT' AS message FROM customer UNION ALL SELECT 'C:' || c_custkey, 'vip', 'missing required field "vip"' FROM customer""")
def schema_errors(spark, d):
    schema = {"nation": {"type": "string", "required": True}, "vip": {"type": "any", "required": True}, "note": {"type": "string", "required": False}}
    rows = G.buyers(spark, d).vertices.filter("id LIKE 'C:%'").withColumn("meta_schema", F.from_json(F.lit(json.dumps(schema)), "map<string,struct<type:string,required:boolean>>"))
    return M.schema_errors(rows)


@query("graph_status_counts", f"WITH {CHAIN} SELECT status, count(*) AS nodes FROM oc GROUP BY 1")
def status_counts(spark, d):
    return R.status_counts(G.order_chain(spark, d))


WAITS = f"WITH {CHAIN}, dep AS (SELECT dst AS id, bool_and(status = 'done') AS ok FROM oc WHERE dst IS NOT NULL GROUP BY 1)"


@query("tasks_ready", WAITS + " SELECT oc.id FROM oc LEFT JOIN dep USING (id) WHERE status = 'pending' AND coalesce(ok, true)")
def tasks_ready(spark, d):
    return J.ready(G.order_chain(spark, d))[1]


@query("tasks_compute_ready", WAITS + " SELECT oc.id, CASE WHEN status = 'pending' AND ok THEN 'ready' ELSE status END AS status FROM oc LEFT JOIN dep USING (id)")
def tasks_compute_ready(spark, d):
    return J.compute_ready(G.order_chain(spark, d)).vertices.select("id", "status")


@query("tasks_transition", f"WITH {CHAIN}, f AS (SELECT min(id) AS id FROM oc WHERE status = 'running'), x AS (SELECT oc.id AS id, oc.dst FROM oc JOIN f USING (id)) SELECT x.id, 'running' AS old_status, 'done' AS new_status, CASE WHEN n.status = 'pending' THEN n.id ELSE '' END AS newly_ready FROM x LEFT JOIN oc n ON n.id = x.dst")
def tasks_transition(spark, d):
    g = G.order_chain(spark, d).materialize()
    first = g.vertices.filter("status = 'running'").agg(F.min("id")).first()[0]
    row = J.transition(g, first, "done")[1]
    return one_row(spark, row | {"newly_ready": ",".join(row["newly_ready"])}, "id string, old_status string, new_status string, newly_ready string")


@query("source_snapshot", f"WITH {TRADE} SELECT * FROM e")
def snapshot_round_trip(spark, d):
    return snapshot.unmarshal(spark, snapshot.marshal(G.trade(spark, d))).edges.select("src", "dst", "weight")


@query("source_directory", "SELECT 'root' AS src, p_brand AS dst FROM part WHERE p_size > 25 GROUP BY 2 UNION ALL SELECT p_brand, p_brand || '/' || p_partkey || '.py' FROM part WHERE p_size > 25")
def directory(spark, d):
    parts = G.read(spark, d, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".py").otherwise(".md"))
    files = parts.select(F.concat_ws("/", "p_brand", name).alias("path"), name.alias("name"), F.lit(False).alias("is_dir"), F.col("p_size").cast("long").alias("size"), F.lit("").alias("content"))
    dirs = parts.select(F.col("p_brand").alias("path"), F.col("p_brand").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit("").alias("content")).distinct()
    return loaders.from_directory(files.union(dirs), extensions=["PY"]).edges.select("src", "dst")


@query("source_plan", "SELECT printf('T:%d:%d', conv_id, turn) AS id, printf('T:%d:%d', conv_id, turn) AS label, CASE WHEN turn > 0 AND lag(turn) OVER w IS NOT NULL AND lag(turn) OVER w = 0 THEN 'ready' WHEN turn = 0 THEN 'done' ELSE 'pending' END AS status FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def plan(spark, d):
    t = G.read(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = F.format_string("T:%d:%d", F.col("conv_id"), F.col("turn"))
    before = F.array(F.format_string("T:%d:%d", F.col("conv_id"), F.col("turn") - 1))
    tasks = t.select(name.alias("id"), F.lit("").alias("label"), F.when(F.col("turn") == 0, "done").otherwise("").alias("status"), F.when(F.col("turn") > 0, before).alias("dependencies"))
    return loaders.from_plan(tasks).vertices.select("id", "label", "status")


@query("source_plan_levels", "SELECT printf('T:%d:%d', conv_id, turn) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def plan_levels(spark, d):
    t = G.turns(spark, d)
    tasks = t.vertices.select("id").join(t.edges.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("dependencies")), "id", "left")
    return loaders.plan_levels(tasks.withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>"))))


@query("source_templates", "SELECT * FROM (VALUES ('workflow', 9, 10), ('knowledge', 10, 11), ('dependencies', 11, 13), ('statemachine', 8, 11), ('orgchart', 11, 10), ('microservices', 10, 13), ('taskplan', 8, 8), ('codebase', 25, 30)) t(id, nodes, edges)")
def template_sizes(spark, d):
    return spark.createDataFrame([(t["id"], t["node_count"], t["edge_count"]) for t in templates.template_list()], "id string, nodes int, edges int")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: PageRank and degrees of the trade graph."""
    g = G.trade(spark, d)
    ranks, _, _ = R.pagerank(g)
    return g.vertices.select("id", "label").join(ranks, "id").join(L.degrees(g), "id").orderBy(F.col("score").desc(), "id")
