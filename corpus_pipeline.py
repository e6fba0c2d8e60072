"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; every stage sees all that its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import park, table
from lattica.llm.op2_suffix import without_repeats
from lattica.llm.op3_jaccard import keep_one
from lattica.llm.op4_packing import default_tokenizer, pack_documents
from lattica.llm.op7_toxicity import score_documents, train
from lattica.llm.op9_mixing import mixed_documents

PASSAGE_BYTES = 256  # 50 words of the corpus are longer, but for lists of letters and numbers


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of some 50 words that occur more than once."""
    return without_repeats(docs, window=PASSAGE_BYTES, gram=48)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("suffix", suffix), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
