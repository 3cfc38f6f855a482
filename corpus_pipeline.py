"""The corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkdex.llm import packing, quality, simhash, suffixes
from inkdex.llm.common import materialize, table

REPEAT_BYTES = 200
CAPACITY = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs, bigrams=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEAT_BYTES bytes that occur more than once."""
    return suffixes.cut_repeats(docs, REPEAT_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of CAPACITY tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("repeated passages", suffix_dedup),
    ("packing", pack),
]

#: Perplexity, fingerprints and merged transforms are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, f"stage{n}")
    return docs
