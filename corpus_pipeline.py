"""Corpus pipeline: quality rules, MinHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.

Defined results: rows with a null doc_id pass every stage as documents of their own (near-dedup keeps them, linked with nothing); null, empty and very
short texts fail the quality rules; rows equal in all columns stay or go together until near-dedup, which keeps rows of one doc_id
together; an empty table passes as such; further columns are carried along, whatever their names, and left out by packing alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossa.llm import minhash_dedup, packing, quality_rules, substring_dedup
from glossa.llm.common import finished


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the threshold table go."""
    return quality_rules.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id stays."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated 35-word window are cut."""
    return substring_dedup.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, filled with BM25 neighbours; one row a piece, with its ids."""
    path, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.pack(docs, path, ranks, public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("substring_dedup", passages), ("packing", packed)]
#: Transitive closure over exact similarities and retrieval order are not stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage is written once, in the shared folder, and read by the next; what a stage wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
