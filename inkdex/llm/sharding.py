"""Shards by jump consistent hashing.

A stable key (``doc_id``) is hashed and sent to one of ``n`` shards without a
ring table; when a shard is appended, a row either stays or moves to the new
shard, and 1/(n+1) of the rows move.

Defined cases: a null key hashes as its own value, like any other key; a null
text has size ``row_bytes`` and the checksum of the empty text; repeated rows go to
the same shard with slots of their own; an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.common import materialize, ranked, ship

NULL_KEY = 0x6E756C6C  # what a null key hashes as


def mix(keys: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer: neighbouring ids become unrelated 64-bit keys."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each mixed 64-bit key (Lamping and Veach's jump hash, for a whole array at once)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (2.0**31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_column(key, shards: int):
    """Column of shard numbers for a bigint key column."""

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        keys = ids.fillna(NULL_KEY).to_numpy().astype(np.int64).astype(np.uint64)
        return pd.Series(jump(mix(keys), shards))

    @F.pandas_udf("int")
    def of_null(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(mix(np.full(len(ids), NULL_KEY, dtype=np.uint64)), shards))

    # pandas turns a nullable bigint into doubles, so nulls take a way of their own
    return F.when(key.isNull(), of_null(F.lit(0).cast("bigint"))).otherwise(of(F.coalesce(key, F.lit(0).cast("bigint"))))


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", row_bytes: int = 16) -> DataFrame:
    """Place every row: (key, size, text_crc32, law, shard, slot, grown_shard).

    ``slot`` numbers a shard's rows from 0 in the order of the key.  Only ids,
    sizes and checksums are shuffled, never texts, and a shard's rows are
    numbered by many tasks.
    """
    ship(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).cast("bigint").alias(key),
        (F.octet_length(body) + F.lit(row_bytes)).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", shard_column(F.col(key), shards)).withColumn("grown_shard", shard_column(F.col(key), shards + 1))
    placed, _ = ranked(materialize(rows, "sharding"), "shard", shards, [key, "text_crc32", "size"], "slot")
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
