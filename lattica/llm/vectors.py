"""Blocked vector search: cleaning, packing rows into matrix blocks, pairing blocks, merging heaps.

Queries and candidates become packed blocks (one row per block: ids and a matrix as
bytes). A query block is replicated to the candidate blocks it cannot rule out, joined
on the block number, and searched by a kernel that returns each query's best rows of
that block. A window with a per-partition group limit merges the partial lists. No task
ever holds more than two blocks, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "block long, n int, dim int, ids binary, mat binary"


def clean(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """(id, vec array<double>): rows that take part, one per id.

    Left out: null ids; null vectors; vectors with a null or non-finite component; zero
    and empty vectors if ``drop_zero``. Repeated rows count once; of several vectors for
    one id the greatest in array order counts. Other columns are ignored, so clashing
    names do no harm.
    """
    vec = F.col(vec_col).cast("array<double>")
    df = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.filter(~F.coalesce(bad, F.lit(False)))
    if drop_zero:
        df = df.filter(F.exists("vec", lambda x: x != 0))
    return df.groupBy("id").agg(F.max("vec").alias("vec"))


def matrix(column) -> np.ndarray:
    """An Arrow list<double> column as a matrix; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    dim = int(sizes.max()) if len(sizes) else 0
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def keep_smallest_ids(ids: np.ndarray, mat: np.ndarray, keep: int) -> np.ndarray:
    """Rows of a block that can appear in a result: of equal vectors, the ``keep`` smallest ids.

    With ties going to smaller ids and one row lost to the query itself, k + 1 of a set
    of equal vectors always suffice. Exact, and independent of how many copies there are.
    """
    order = np.argsort(ids, kind="stable")
    _, first, inverse = np.unique(mat[order], axis=0, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    by = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[by], np.arange(len(first)))
    rank = np.arange(len(by)) - starts[inverse[by]]
    return np.sort(order[by[rank < keep]])


def packer(keep: int):
    def pack(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("id"), dtype=np.int64)
        mat = matrix(group.column("vec"))
        rows = keep_smallest_ids(ids, mat, keep) if keep else np.arange(len(ids))
        rows = rows[np.argsort(ids[rows], kind="stable")]
        block = group.column("block")[0].as_py()
        return pa.table(
            {"block": pa.array([block], pa.int64()), "n": pa.array([len(rows)], pa.int32()), "dim": pa.array([mat.shape[1]], pa.int32()),
             "ids": pa.array([ids[rows].tobytes()], pa.binary()), "mat": pa.array([np.ascontiguousarray(mat[rows]).tobytes()], pa.binary())}
        )

    return pack


def packed(df: DataFrame, keep: int = 0) -> DataFrame:
    """(id, vec, block) to one row per block; ``block`` bounds the rows of a group."""
    return df.select("id", "vec", "block").groupBy("block").applyInArrow(packer(keep), PACKED)


def unpack(ids: bytes, mat: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(mat, np.float64).reshape(n, dim)


def padded(mat: np.ndarray, dim: int) -> np.ndarray:
    return mat if mat.shape[1] == dim else np.pad(mat, ((0, 0), (0, dim - mat.shape[1])))


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best (score descending, id ascending) in flat candidate lists."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    start = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - start < k]


def search_pairs(queries: DataFrame, refs: DataFrame, targets: DataFrame, kernel, score_type: str) -> DataFrame:
    """Join query blocks to their target blocks and run ``kernel`` on each pair.

    ``targets`` has (q, block): the candidate blocks each query block must visit.
    ``kernel(block, q_ids, q_mat, r_ids, r_mat)`` returns (query ids, ids, scores).
    """
    q = queries.select(F.col("block").alias("q"), F.col("n").alias("qn"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    sent = q.join(targets, "q").join(refs, "block").drop("q")
    arrow_type = pa.int64() if score_type == "long" else pa.float64()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                r_ids, r_mat = unpack(row["ids"], row["mat"], row["n"], row["dim"])
                q_ids, q_mat = unpack(row["qids"], row["qmat"], row["qn"], row["qdim"])
                dim = max(row["dim"], row["qdim"])
                a, b, s = kernel(row["block"], q_ids, padded(q_mat, dim), r_ids, padded(r_mat, dim))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, arrow_type)], ["query_id", "vec_id", "score"])

    return sent.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def merge(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best over all blocks; ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
