"""Exact top-k search by dual-tree cover-tree traversal over integer vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import vectors as V
from lattica.llm.common import park, table

SCALE = 64.0
LEAF, FAN, FLAT = 256, 16, 0.6
LONG = (-(2**63), 2**63 - 1)


class Node:
    """A subtree: its rows, its centre, and the radius that covers them."""

    __slots__ = ("rows", "centre", "norm", "radius", "kids")

    def __init__(self, rows, centre, radius):
        self.rows, self.centre, self.radius, self.kids = rows, centre, radius, ()
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(mat: np.ndarray, leaf: int = LEAF) -> Node:
    """Batch-built cover tree. A node of over ``leaf`` rows is split by farthest-first centres,
    until they cover it within half its radius or there are FAN of them; its children are
    split in turn. Where the split shows no structure, the rows lying on average in leaves of
    more than FLAT of its radius, the node becomes a leaf: its parts could not be ruled out
    one by one, and one dense tile is cheaper."""
    far = np.sqrt(((mat - mat[0]) ** 2).sum(1))
    root = Node(np.arange(len(mat)), mat[0], float(far.max()))
    open_nodes, made = [(root, far)], [root]
    while open_nodes:
        node, dist = open_nodes.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        pts, reach = mat[node.rows], node.radius / 2
        nearest, owner, centres, dists = dist.copy(), np.zeros(len(pts), int), [node.centre], [dist]
        while len(centres) < FAN and nearest.max() > reach:
            c = pts[int(nearest.argmax())]
            d = np.sqrt(((pts - c) ** 2).sum(1))
            closer = d < nearest
            owner[closer] = len(centres)
            nearest = np.minimum(nearest, d)
            centres.append(c)
            dists.append(d)
        if np.bincount(owner).max() == len(pts):  # rounding: no centre drew any row
            continue
        kids = []
        for j, c in enumerate(centres):
            mine = np.nonzero(owner == j)[0]
            if len(mine):
                kid = Node(node.rows[mine], c, float(dists[j][mine].max()))
                kids.append(kid)
                open_nodes.append((kid, dists[j][mine]))
        node.kids = tuple(kids)
        made += kids
    reach_of: dict[int, float] = {}  # radii of the leaves below, each row counted
    for node in reversed(made):
        below = sum(reach_of.pop(id(k)) for k in node.kids)
        if below > FLAT * node.radius * len(node.rows):
            node.kids = ()
        reach_of[id(node)] = below if node.kids else node.radius * len(node.rows)
    return root


def bound(q: Node, r: Node) -> float:
    """No inner product of a row under q and a row under r exceeds this (slack for rounding)."""
    top = float(q.centre @ r.centre) + q.norm * r.radius + r.norm * q.radius + q.radius * r.radius
    return top + 1e-9 * (abs(top) + (q.norm + q.radius) * (r.norm + r.radius)) + 1e-9


class Heaps:
    """The k best (score, id) of each query so far; scores are exact whole numbers."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.scored = k, floor.astype(float).copy(), 0  # pairs of rows scored so far
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, tile: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        least = self.floor[rows]
        if tile.shape[1] > k:
            least = np.maximum(least, np.partition(tile, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k])
        at, col = np.nonzero((tile >= least[:, None]) & (tile > -np.inf))
        if not len(at):
            return
        touched, local = np.unique(at, return_inverse=True)
        mine = rows[touched]
        flat_rows = np.concatenate([local, np.repeat(np.arange(len(mine)), k)])
        flat_scores = np.concatenate([tile[at, col], self.scores[mine].ravel()])
        flat_ids = np.concatenate([ids[col], self.ids[mine].ravel()])
        chosen = V.best(flat_rows, flat_scores, flat_ids, k).reshape(len(mine), k)
        self.scores[mine], self.ids[mine] = flat_scores[chosen], flat_ids[chosen]
        self.floor[mine] = np.maximum(self.floor[mine], self.scores[mine, -1])


def dual_search(q_tree: Node, r_tree: Node, q_ids, q_mat, r_ids, r_mat, k: int, floor: np.ndarray) -> Heaps:
    """Visit node pairs, best bound first; skip a pair whose bound is under the group's worst kth score."""
    heaps = Heaps(len(q_ids), k, floor)
    pairs = [(q_tree, r_tree, bound(q_tree, r_tree))]
    while pairs:
        q, r, top = pairs.pop()
        if top < heaps.floor[q.rows].min():
            continue
        if not q.kids and not r.kids:
            tile = q_mat[q.rows] @ r_mat[r.rows].T
            heaps.scored += tile.size
            own = q_ids[q.rows][:, None] == r_ids[r.rows][None, :]
            tile[own] = -np.inf
            heaps.offer(q.rows, tile, r_ids[r.rows])
            continue
        split_q = bool(q.kids) and (not r.kids or q.radius >= r.radius)
        nexts = [(a, r) for a in q.kids] if split_q else [(q, b) for b in r.kids]
        pairs += sorted(((a, b, bound(a, b)) for a, b in nexts), key=lambda p: p[2])
    return heaps


def exact_large(q_ids, q_mat, r_ids, r_mat, k: int):
    """Python integers, for components so large that doubles cannot hold the products."""
    out = []
    cols = [[int(x) for x in row] for row in r_mat]
    for qid, row in zip(q_ids.tolist(), q_mat):
        q = [int(x) for x in row]
        scored = sorted((-sum(a * b for a, b in zip(q, c)), rid) for c, rid in zip(cols, r_ids.tolist()) if rid != qid)
        out += [(qid, rid, min(max(-s, LONG[0]), LONG[1])) for s, rid in scored[:k]]
    a, b, s = zip(*out) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(s, np.int64)


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres: the top level of the tree over the whole table."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def exact_topk(df: DataFrame, k: int, query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
               block_rows: int = 4096, cells: int = 32, sample_rows: int = 2048, leaf: int = LEAF) -> DataFrame:
    """Each query's k rows of largest integer inner product of floor(64 x) vectors.

    ``query`` is a condition on the column ``id``. Candidates are all rows but the
    query's own id; ties go to smaller ids; fewer than k candidates give fewer rows.
    Null ids, null vectors and vectors with null or non-finite components take no part;
    repeated rows count once; shorter vectors are padded with zeros; scores beyond a
    long saturate. An empty table gives no rows. Columns: query_id, rank, vec_id, score.

    A sample of at most ``sample_rows`` rows gives the centres of the top tree level and
    each query's first kth-score bound; every row is indexed and every cell that the
    bound cannot rule out is searched, so the result is exact whatever the sample.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = V.clean(df, id_col, vec_col, False).withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE).cast("double")))
    rows = park(rows, "topk-rows")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    dim = max(len(r.vec) for r in sample)
    s_ids = np.array([r.id for r in sample], np.int64)
    s_mat = np.array([list(r.vec) + [0.0] * (dim - len(r.vec)) for r in sample]).reshape(len(sample), dim)
    centres = far_apart(s_mat, cells)

    def assign(batches):
        for batch in batches:
            mat = V.matrix(batch.column("vec"))
            width = max(mat.shape[1], dim)
            c = V.padded(centres, width)
            mat = V.padded(mat, width)
            d2 = (mat**2).sum(1)[:, None] - 2 * (mat @ c.T) + (c**2).sum(1)[None, :]
            cell = d2.argmin(1) if len(mat) else np.zeros(0, int)
            dist = np.sqrt(((mat - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(dist)], ["id", "vec", "cell", "dist"])

    placed = park(rows.mapInArrow(assign, "id long, vec array<double>, cell int, dist double"), "topk-cells")
    # one row per cell: at most `cells` rows reach the driver
    stats = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
    salts = {c: max(1, math.ceil(r.n / block_rows)) for c, r in stats.items()}
    first = dict(zip(sorted(salts), np.cumsum([0] + [salts[c] for c in sorted(salts)]).tolist()))
    cell_of_block = [c for c in sorted(salts) for _ in range(salts[c])]
    base = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])])
    width = F.create_map(*[F.lit(x) for c in salts for x in (c, salts[c])])
    blocks = placed.withColumn("block", (base[F.col("cell")] + F.pmod(F.xxhash64("id"), width[F.col("cell")])).cast("long"))
    asked = blocks.filter(query)
    refs = V.packed(blocks, keep=k + 1)
    queries = park(V.packed(asked), "topk-queries")
    block_cells = {c: (V.padded(centres, dim)[c], float(stats[c].radius), first[c], salts[c]) for c in stats}

    def floors(q_ids, q_mat):
        if len(s_ids) <= k:
            return np.full(len(q_ids), -np.inf)
        width = max(q_mat.shape[1], dim)
        tile = V.padded(q_mat, width) @ V.padded(s_mat, width).T
        tile[q_ids[:, None] == s_ids[None, :]] = -np.inf
        return np.partition(tile, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k]

    def plan(batches):
        """The blocks of each query block that its worst kth score cannot rule out."""
        for batch in batches:
            q, to = [], []
            for i in range(batch.num_rows):
                ids, mat = V.unpack(batch.column("ids")[i].as_py(), batch.column("mat")[i].as_py(), batch.column("n")[i].as_py(), batch.column("dim")[i].as_py())
                width = max(mat.shape[1], dim)
                mat = V.padded(mat, width)
                c = mat.mean(0)
                group = Node(np.arange(len(ids)), c, float(np.sqrt(((mat - c) ** 2).sum(1)).max()))
                worst = floors(ids, mat).min()
                for centre, radius, at, n in block_cells.values():
                    if bound(group, Node(None, V.padded(centre[None, :], width)[0], radius)) >= worst:
                        q += [batch.column("block")[i].as_py()] * n
                        to += range(at, at + n)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(to, pa.int64())], ["q", "block"])

    targets = queries.mapInArrow(plan, "q long, block long")
    trees: dict = {}

    def kernel(block, q_ids, q_mat, r_ids, r_mat):
        if float(np.abs(q_mat).max(initial=0)) * float(np.abs(r_mat).max(initial=0)) * max(1, q_mat.shape[1]) >= 2.0**53:
            return exact_large(q_ids, q_mat, r_ids, r_mat, k)
        key = (block, len(r_ids), r_mat.shape[1])
        if key not in trees:
            trees.clear()
            trees[key] = cover_tree(r_mat, leaf)
        heaps = dual_search(cover_tree(q_mat, leaf), trees[key], q_ids, q_mat, r_ids, r_mat, k, floors(q_ids, q_mat))
        at, col = np.nonzero(heaps.scores > -np.inf)
        return q_ids[at], heaps.ids[at, col], heaps.scores[at, col].astype(np.int64)

    found = V.search_pairs(queries, refs, targets, kernel, "long")
    return V.merge(found, k)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), 20, F.col("id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(r.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
QUERIES, ORACLE_SQL = {"op1_topk": op1_topk}, {"op1_topk": ORACLE}
