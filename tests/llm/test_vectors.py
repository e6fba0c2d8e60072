import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.op1_topk import cover_tree, dual_search, exact_topk
from lattica.llm.op6_ann import nearest

KIND = "vec_id long, embedding array<float>, id string, block int, query_id string"


def rows_of(n, dim, rng, copies=0):
    base = [[rng.choice([-1.5, -0.5, 0.0, 0.25, 1.0]) for _ in range(dim)] for _ in range(n - copies)]
    return base + [base[0]] * copies


def frame(spark, vectors, ids=None):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in zip(ids or range(len(vectors)), vectors)], KIND)


def brute(vectors, k, scale):
    live = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items() if v is not None and None not in v and all(map(math.isfinite, v)) and (scale or any(v))}
    if scale:
        live = {i: np.floor(64 * v) for i, v in live.items()}
    out = {}
    for q in live:
        if q % 20 == 0:
            s = sorted((-float(live[q] @ live[r]), r) for r in live if r != q)[:k]
            out |= {(q, n): (r, -x) for n, (x, r) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("op", [exact_topk, nearest])
@pytest.mark.parametrize("copies", [0, 50])
def test_against_brute_force(spark, op, copies):
    rng = random.Random(3)
    vectors = dict(enumerate(rows_of(130, 6, rng, copies)))
    vectors |= {140: None, 141: [None] * 6, 160: [float("nan")] * 6, 161: [float("inf")] * 6, 180: [0.0] * 6}
    df = frame(spark, list(vectors.values()), list(vectors))
    got = {(r.query_id, r.rank): (r.vec_id, float(r.score)) for r in op(df.union(df), 7, F.col("id") % 20 == 0, block_rows=32).collect()}
    want = brute(vectors, 7, op is exact_topk)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def clustered(n, dim, rng, clusters=12):
    centres = [[rng.uniform(-9, 9) for _ in range(dim)] for _ in range(clusters)]
    return [[x + rng.gauss(0, 0.05) for x in rng.choice(centres)] for _ in range(n)]


def test_trees_prune_clusters():
    """Trees deeper than one level; most pairs of rows in clusters are never scored, and none is lost."""
    rng = random.Random(6)
    mat = np.floor(64 * np.array(clustered(1500, 5, rng)))
    tree = cover_tree(mat, 16)
    nodes, depth = [(tree, 1)], 0
    while nodes:
        node, d = nodes.pop()
        depth = max(depth, d)
        assert np.sqrt(((mat[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        assert not node.kids or sorted(np.concatenate([k.rows for k in node.kids])) == sorted(node.rows)
        nodes += [(k, d + 1) for k in node.kids]
    assert depth > 2
    q, ids = np.arange(0, 1500, 20), np.arange(1500)
    found = dual_search(cover_tree(mat[q], 16), tree, q, mat[q], ids, mat, 7, np.full(len(q), -np.inf))
    assert found.scored < 0.5 * len(q) * 1500
    want = brute(dict(enumerate((mat / 64).tolist())), 7, True)
    assert {(int(a), n): int(r) for a, rows in zip(q, found.ids) for n, r in enumerate(rows, 1)} == {k: v[0] for k, v in want.items()}


def test_trees_in_blocks(spark):
    rng = random.Random(7)
    vectors = dict(enumerate(clustered(700, 4, rng) + rows_of(100, 4, rng)))
    got = exact_topk(frame(spark, list(vectors.values())), 7, F.col("id") % 20 == 0, block_rows=200, leaf=16).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {k: v[0] for k, v in brute(vectors, 7, True).items()}


@pytest.mark.parametrize("op", [exact_topk, nearest])
def test_small_tables(spark, op):
    assert op(frame(spark, []), 5, F.col("id") % 20 == 0).collect() == []
    assert op(frame(spark, [[1.0, 2.0]]), 5, F.col("id") % 20 == 0).collect() == []
    two = op(frame(spark, [[1.0, 2.0], [1.0]]), 5, F.col("id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 1)]


def test_components_beyond_doubles(spark):
    def ranked(x):
        df = spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0]), (2, [x, 3.0])], "vec_id long, embedding array<double>")
        return [(r.vec_id, r.score) for r in exact_topk(df, 2, F.col("id") == 0).orderBy("rank").collect()]

    big = (64 * 30_000_000) ** 2  # no double can tell these two scores apart
    assert ranked(3e7) == [(2, big + 64 * 192), (1, big + 64 * 128)]
    assert ranked(3e8) == [(1, 2**63 - 1), (2, 2**63 - 1)]  # saturated scores tie
