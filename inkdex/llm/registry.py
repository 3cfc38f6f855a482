"""Queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkdex.llm import attribution, bpe, licenses, masked_lm, oracles, packing, quality, sharding, simhash, suffixes, vptree
from inkdex.llm.common import table

#: The share of the k-th distance within which a vantage-point tree looks on; README has what it looks at and recalls.
VP_FACTOR = 0.18


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, links and components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.label_documents(table(spark, sf_dir, "documents")).drop("matches")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdicts for all documents."""
    found = quality.assess(table(spark, sf_dir, "documents"), bigrams=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_nats", "word_nats")


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of all documents under a network trained on all of them."""
    return masked_lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, among all."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100, factor=VP_FACTOR)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur more than once."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's source, language and lines of text."""
    return attribution.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        fields=["source", "lang", "text"], by_line=("text",))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    both = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3_licenses SQL can express: the fixed phrases."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4_quality SQL can express: the counted features and the base rules, which need no model."""
    found = quality.counted(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_vptree with factor one, which misses nothing."""
    found = vptree.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100, factor=1.0)
    return found.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_masked_lm": op5_masked_lm,
    "op6_vptree": op6_vptree,
    "op7_sharding": op7_sharding,
    "op8_suffixes": op8_suffixes,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "license_phrases": license_phrases,
    "quality_features": quality_features,
    "exact_neighbours": exact_neighbours,
}

#: The other operators need vocabularies, 64-bit hashes of shingles, models or automata, which SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_sharding": oracles.shards(40),
    "op8_suffixes": oracles.repeats(200),
    "license_phrases": oracles.license_phrases(),
    "quality_features": oracles.features(quality.MIN_WORDS, quality.MAX_REPEATED, quality.GRAM),
    "exact_neighbours": oracles.neighbours(10, 100),
}
