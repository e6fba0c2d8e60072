"""Shared pieces: scratch tables in the cluster's shared folder, and null-safe inputs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a session on one machine, as in
    tests, gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattica-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def park(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation. The
    files live as long as the shared scratch folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def binary_views(column) -> list:
    """Zero-copy memoryviews of an Arrow string/binary column without nulls."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, start = len(column), column.offset
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[start : start + n + 1]
    body = memoryview(data) if data is not None else memoryview(b"")
    return [body[int(a) : int(b)] for a, b in zip(ends[:-1], ends[1:])]


SLOTS = 1 << 23


def slot_of(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def slot_bits(rows: DataFrame, *keys):
    """A bitmap of fixed size (1 MB) of the slots of ``rows``, as a broadcast of 64-bit words."""
    words = rows.select(slot_of(*keys).alias("slot")).groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toArrow()  # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS // 64, np.uint64)
    bits[np.asarray(words.column("w"), dtype=np.int64)] = np.asarray(words.column("bits"), dtype=np.int64).view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def in_slots(bits, slots):
    """Which of the slots, an Arrow column, the bitmap holds."""
    at = np.asarray(slots, dtype=np.int64)
    return ((bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def marked_rows(rows: DataFrame):
    """A test (doc_id, hash) of whether ``rows`` has a row's doc_id and h: always true if it has,
    seldom if not. It keeps rows that need no join out of its shuffle; where a table is so large
    that the bitmap fills up, more rows are moved and the result is the same."""
    held = slot_bits(rows, "doc_id", "h")

    def marked(doc_id, h) -> Column:
        @F.arrow_udf("boolean")
        def hit(slots: pa.Array) -> pa.Array:
            return pa.array(in_slots(held.value, slots))

        return hit(slot_of(doc_id, h))

    return marked


def unique_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id and text; ``known`` has their (doc_id, th) pairs.
    Texts are moved only where some row does repeat."""
    if known.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        return docs
    return docs.withColumn("_th", F.xxhash64(text_of().cast("binary"))).dropDuplicates(["doc_id", "_th"]).drop("_th")


_held: dict = {}


def worker_state(key, make):
    """What a Python worker keeps between tasks, such as a word cache. One thing at a time:
    another operator's state replaces it, so that reused workers do not add up their caches."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Gives a worker's freed memory back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """1,000 rows an Arrow batch from now on in this session: whole texts are large rows, and
    a batch exists several times over, in the JVM and in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
