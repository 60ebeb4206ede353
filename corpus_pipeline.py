"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Toxic documents go, then those of poor quality, then all but one of each group of near duplicates;
benchmark passages are cut from what stays, and the last stage turns texts into SentencePiece ids.
Stages take (spark, docs, sf_dir); all but the last return the columns of documents. A stage works
on every row that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm.decontaminate import remove_contamination
from kelpline.llm.minhash_dedup import one_of_each
from kelpline.llm.quality import keep_good
from kelpline.llm.sentencepiece_codec import encode_and_check
from kelpline.llm.store import Scratch
from kelpline.llm.toxicity import drop_toxic

#: The pipeline's near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: More keys than the operator's default keep the chance to miss a pair at this lower threshold below 1e-4.
HALF_KEYS = 14


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays; rows without a doc_id stay."""
    return one_of_each(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT, half_keys=HALF_KEYS)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, ids, n_tokens and round_trip of each document, one without words or text included."""
    return encode_and_check(docs, ["doc_id", "text"])


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("quality", drop_poor_documents),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("sentencepiece", encode_documents),
]

#: Trained and hashed stages can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
