"""Nearest neighbours by a block matrix join over int8 tiles with quantisation error bounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import vectors as V
from lattica.llm.common import park, table

CHUNK = 1024  # 127 * 127 * 1024 < 2 ** 24: float32 sums of int8 products are whole and exact


def quantise(mat: np.ndarray):
    """int8 rows, scales, norms of what is represented, norms of the error."""
    scale = np.abs(mat).max(1, initial=0) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(mat / scale[:, None]).astype(np.int8)
    shown = q * scale[:, None]
    return q, scale, np.sqrt((shown**2).sum(1)), np.sqrt(((mat - shown) ** 2).sum(1))


def int8_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exact; float32 BLAS does the work in chunks that stay whole."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], CHUNK):
        out += a[:, i : i + CHUNK].astype(np.float32) @ b[:, i : i + CHUNK].astype(np.float32).T
    return out


def tile_search(q_ids, q_mat, r_ids, r_mat, k: int):
    """Each query's k nearest of one block.

    |q.x - q'.x'| <= |q'||ex| + |eq||x'| + |eq||ex| bounds each tile score. The kth largest
    lower bound is a floor; pairs whose upper bound reaches it are recomputed in double.
    """
    qa, qs, qn, qe = quantise(q_mat)
    ra, rs, rn, re = quantise(r_mat)
    tile = int8_tile(qa, ra) * qs[:, None] * rs[None, :]
    slack = (qn[:, None] * re[None, :] + qe[:, None] * (rn + re)[None, :]) * (1 + 1e-9) + 1e-12 * (qn[:, None] * rn[None, :])
    own = np.searchsorted(r_ids, q_ids)
    hit = (own < len(r_ids)) & (r_ids[np.minimum(own, len(r_ids) - 1)] == q_ids)
    tile[np.nonzero(hit)[0], own[hit]] = -np.inf
    low = tile - slack
    floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(q_ids), -np.inf)
    at, col = np.nonzero((tile + slack >= floor[:, None]) & (tile > -np.inf))
    scores = np.concatenate([np.einsum("ij,ij->i", q_mat[at[i : i + 65536]], r_mat[col[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.zeros(0)])
    chosen = V.best(at, scores, r_ids[col], k)
    return q_ids[at[chosen]], r_ids[col[chosen]], scores[chosen]


def nearest(df: DataFrame, k: int, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """Each query's k rows of largest inner product, in double precision.

    ``query`` is a condition on the column ``id``. Candidates are all rows but the query's
    own id; ties go to smaller ids; fewer candidates give fewer rows. Null ids and vectors
    that are null, zero, empty or hold null or non-finite components take no part;
    repeated rows count once; shorter vectors are padded with zeros; an empty table gives
    no rows. Every row is searched and the bounds are safe, so recall is 1. Columns:
    query_id, rank, vec_id, score.
    """
    rows = park(V.clean(df, id_col, vec_col, True), "ann-rows")
    n = rows.count()
    n_blocks = max(1, math.ceil(n / block_rows))
    refs = V.packed(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), keep=k + 1)
    asked = rows.filter(query)
    q_blocks = max(1, math.ceil(asked.count() / 1024))
    queries = V.packed(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(q_blocks))))
    targets = df.sparkSession.range(q_blocks).select(F.col("id").alias("q"), F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("block"))
    found = V.search_pairs(queries, refs, targets, lambda block, *m: tile_search(*m, k), "double")
    return V.merge(found, k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 20, F.col("id") % 20 == 0)


QUERIES, ORACLE_SQL = {"op6_ann": op6_ann}, {}
