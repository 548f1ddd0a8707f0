"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes all documents that the one before kept, its decisions take
effect in the rows it returns, and its result is written as Parquet (in the
shared folder of ``spark.checkpoint.dir``) and read again for the next.
Defined cases (nulls, empty texts, repeated rows, empty tables, extra columns)
are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from topicspark.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from topicspark.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, n=5, t=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that also start in a document with a smaller doc_id are cut out."""
    return substring_dedup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens: a row for each piece."""
    return packing.packed_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

# The classifier is trained and the tokenizer's ids are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
