"""Token counts of documents in flat token streams: a separator scan with a prefix scan over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import park, small_batches, table, text_of, worker_state
from lattica.llm.op4_packing import WordTokenizer, default_tokenizer

END = 65_535  # end of a document: no id of the 49,408 in the vocabulary
BLOCK = 1 << 17  # tokens; small enough that a Parquet writer holds few MB of blocks
FLAT = "file_id long, block long, data binary, ids array<long>"


def write_flat(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """(file_id, block, data, ids): each partition's documents as one flat stream of unsigned
    16-bit ids, an END after each document, cut into blocks without regard to documents.
    Rows with ``ids`` instead of data list the stream's doc_ids in order, but no places."""

    def run(batches):
        words = worker_state(("tokenizer", tokenizer), lambda: WordTokenizer(tokenizer))
        if len(words.ends) > END:
            raise ValueError(f"a vocabulary of {len(words.ends)} ids does not fit 16 bits with an end mark")
        task = TaskContext.get()
        file_id, names = task.partitionId() if task else 0, ["file_id", "block", "data", "ids"]
        rest, n_blocks, n_docs, end = np.zeros(0, np.uint16), 0, 0, np.array([END], np.uint16)

        def row(number, data, ids):
            return pa.RecordBatch.from_arrays([pa.array([file_id], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pieces = [rest]
                for b in words.ids(part.column("text").to_pylist()):
                    pieces += [np.frombuffer(b, np.uint32).astype(np.uint16), end]
                rest = np.concatenate(pieces)
                while len(rest) >= block:
                    yield row(n_blocks, rest[:block].tobytes(), None)
                    rest, n_blocks = rest[block:], n_blocks + 1
                yield row(n_docs, None, part.column("doc_id").to_pylist())
                n_docs += part.num_rows
        if len(rest):
            yield row(n_blocks, rest.tobytes(), None)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, FLAT)


def find_ends(end: int):
    """Block rows to (file_id, block, n, n_ends, last, ends): one vectorised search each."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint16)
                ends = np.flatnonzero(tokens == end)
                out.append((len(tokens), len(ends), int(ends[-1]) if len(ends) else None, ends.astype(np.int32)))
            c = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(list(c[3]), pa.list_(pa.int32()))], ["file_id", "block", "n", "n_ends", "last", "ends"])

    return run


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file_id, doc_index, start, n_tokens, ended) of every document in (file_id, block, data).

    A block knows its own ends only. A prefix scan gives it what came before: tokens, ends and
    the place of the last end. It runs in two levels, within ranges of blocks and over one row
    for each range, so that a single file of any size stays spread out. Tokens after a file's
    last end are a document that has not ended; empty blocks are legal; an empty table gives
    no rows. Blocks are numbered in order within a file; gaps in the numbers do no harm.
    """
    found = blocks.select("file_id", "block", "data").filter("data IS NOT NULL").mapInArrow(find_ends(end), "file_id long, block long, n long, n_ends long, last long, ends array<int>")
    found = park(found.repartitionByRange("file_id", "block").withColumn("_range", F.spark_partition_id()), "ends")
    local = Window.partitionBy("file_id", "_range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = found.withColumn("at", F.coalesce(F.sum("n").over(local), F.lit(0))).withColumn("index", F.coalesce(F.sum("n_ends").over(local), F.lit(0)))
    inner = inner.withColumn("own", F.max(F.col("at") + F.col("last")).over(local))
    ranges = inner.groupBy("file_id", "_range").agg(F.sum("n").alias("rn"), F.sum("n_ends").alias("re"), F.max(F.col("at") + F.col("last")).alias("rl"))
    before = Window.partitionBy("file_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ra", F.coalesce(F.sum("rn").over(before), F.lit(0))).withColumn("ri", F.coalesce(F.sum("re").over(before), F.lit(0)))
    ranges = ranges.withColumn("rp", F.max(F.col("ra") + F.col("rl")).over(before)).select("file_id", "_range", "ra", "ri", "rp")
    placed = inner.join(ranges, ["file_id", "_range"])
    placed = placed.select("file_id", (F.col("ra") + F.col("at")).alias("at"), (F.col("ri") + F.col("index")).alias("index"), F.coalesce(F.col("ra") + F.col("own"), "rp", F.lit(-1)).alias("prev"), "n", "n_ends", "last", "ends")
    starts = F.transform("ends", lambda e, i: F.struct((F.col("index") + i).alias("doc_index"), (F.when(i == 0, F.col("prev")).otherwise(F.col("at") + F.get("ends", i - 1)) + 1).alias("start"), (F.col("at") + e).alias("stop")))
    ended = placed.select("file_id", F.explode(starts).alias("d")).select("file_id", "d.doc_index", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    files = placed.groupBy("file_id").agg(F.max(F.col("at") + F.col("n")).alias("size"), F.max(F.col("index") + F.col("n_ends")).alias("doc_index"), F.max(F.coalesce(F.col("at") + F.col("last"), "prev")).alias("prev"))
    open_ = files.filter("size > prev + 1").select("file_id", "doc_index", (F.col("prev") + 1).alias("start"), (F.col("size") - F.col("prev") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def count_tokens(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, file_id, doc_index, start, n_tokens) of every document, its text tokenized.

    Null and empty texts count 0 tokens; null doc_ids are kept; repeated rows are documents
    of their own; other columns are ignored; an empty table gives no rows.
    """
    flat = park(write_flat(docs, tokenizer, block), "flat")
    counts = scan(flat)
    ids = flat.filter("ids IS NOT NULL").select("file_id", F.col("block").alias("first"), F.posexplode("ids").alias("i", "doc_id"))
    ids = ids.select("file_id", (F.col("first") + F.col("i")).alias("doc_index"), "doc_id")
    return ids.join(counts, ["file_id", "doc_index"]).select("doc_id", "file_id", "doc_index", "start", "n_tokens")


def op5_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES, ORACLE_SQL = {"op5_tokencounts": op5_tokencounts}, {}
