"""The training-corpus pipeline: stages in order, each a table of documents in and out.

Every stage reads all that its predecessor kept, written as Parquet in between; the last one returns
the packed pieces. All stages take rows with nulls in any column, empty and very long texts, repeated rows and further
columns; each says what becomes of them. A table without rows passes as one without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.decontaminate import without_benchmark
from spanledger.llm.minhash import one_of_each
from spanledger.llm.packing import pack
from spanledger.llm.pii import mask_personal_data
from spanledger.llm.toxicity import without_toxic
from spanledger.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the recurrent network rejects. Null and empty texts score low and stay; rows with a null doc_id
    are judged by their text; repeated rows share their fate."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates. Empty and null texts are like nothing and stay, as do rows without a
    doc_id; of rows that share a doc_id one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none; rows are judged by their text, with
    and without a doc_id, and repeated ones alike."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars, where there is one, follows the text. A null text stays null; every row stays."""
    masked = mask_personal_data(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences. A null or empty text is its end id alone; repeated rows are packed each."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# a trained network decides and a tokenizer cuts: no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
