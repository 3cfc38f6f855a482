"""Near duplicates by SimHash fingerprints and an anchor-point covering.

The 64 bits of a fingerprint are cut into blocks of 23, 23, 15 and 3 bits.  The
anchors are the words of the product code Golay[23,12] x Golay[23,12] x
Hamming[15,11] x {0}, 2^35 of them; its covering radius is 3 + 3 + 1 + 3.  If two
fingerprints differ in at most 2 bits, some point lies within one bit of both,
and the anchor that covers that point lies within covering radius plus one of
both.  So each distinct fingerprint is replicated to the anchors that cover it or
a point one bit away (18 at most), and fingerprints are compared per anchor; no
link is missed.  Copies are counted before anything is replicated.

Defined cases: a null text is empty; texts without a word have fingerprint zero
and link like any other; rows that repeat an id are counted as documents of their
own; a null id never names a component; texts of any length are read whole; an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import as_bytes
from inkdex.llm.common import materialize, release, reserved, ship, small
from inkdex.llm.graphs import components

SEED = 42
THRESHOLD = 2
CHUNK = 1 << 16
_SUM, _SIZE = "__inkdex_sum", "__inkdex_size"


def fingerprint(text: bytes) -> int:
    """Fingerprint of a text as an unsigned number; bit k is set if it is set in over half the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp) of every whole text, and the carried bigint columns; fp is the fingerprint's bits as a signed bigint."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=[key, "fp", *carry])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text), *[F.col(c).cast("bigint").alias(c) for c in carry]).mapInArrow(
        run, ", ".join([f"`{key}` bigint", "fp bigint", *[f"{c} bigint" for c in carry]]))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and for each 11-bit syndrome the message bits to flip."""
    generator = 0b101011100011  # of the cyclic [23,12] code
    parity = np.zeros(4096, dtype=np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= generator << (bit - 11)
        parity[message] = rest
    flip = np.full(2048, -1, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            flip[parity[error >> 11] ^ (error & 2047)] = error >> 11
    assert (flip >= 0).all()  # the code is perfect: errors of up to three bits have all syndromes
    return parity, flip


def _golay_anchor(block: np.ndarray) -> np.ndarray:
    parity, flip = _golay()
    message = block >> 11
    return message ^ flip[parity[message] ^ (block & 2047)]


@cache
def _hamming() -> np.ndarray:
    """The covering word of each 15-bit block."""
    block = np.arange(1 << 15)
    syndrome = np.zeros_like(block)
    for k in range(15):
        syndrome ^= np.where(block >> k & 1, k + 1, 0)
    return block ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every anchor that covers a fingerprint or a point one bit away from it, each once."""
    x = fp.view(np.uint64)
    a, b, c = ((x >> np.uint64(s)).astype(np.int64) & m for s, m in ((41, 2**23 - 1), (18, 2**23 - 1), (3, 2**15 - 1)))
    near = lambda block, bits, of: of(np.concatenate([block[:, None], block[:, None] ^ (1 << np.arange(bits))], axis=1))
    na, nb, nc = near(a, 23, _golay_anchor), near(b, 23, _golay_anchor), near(c, 15, lambda v: _hamming()[v])
    join = lambda p, q, r: p << 27 | q << 15 | r
    found = np.concatenate([
        join(na, nb[:, :1], nc[:, :1]), join(na[:, :1], nb[:, 1:], nc[:, :1]), join(na[:, :1], nb[:, :1], nc[:, 1:])], axis=1)
    found.sort(axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rows = np.nonzero(first)[0]
    return rows, found[first]


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: the pairs of distinct fingerprints (column fp) that differ in at most two bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), CHUNK):
                part = fp[at : at + CHUNK]
                rows, found = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], names=["anchor", "fp"])

    copies = materialize(fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint"), "anchors")
    a, b = copies.select("anchor", F.col("fp").alias("u")), copies.select("anchor", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD
    found = materialize(a.join(b.hint("merge"), "anchor").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct(), "links")
    release(copies)
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, n_near, component_id) of every document.

    ``n_near`` counts the other documents whose fingerprints differ in at most
    two bits; ``component_id`` is the smallest id that links reach.
    """
    rows = materialize(fingerprints(df, key, text), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")), "distinct-fingerprints")
    pairs = links(fps)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(fps.select(F.col("fp").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("others"))
    roots = materialize(components(pairs), "roots")
    named = roots.join(fps, roots.node == fps.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(named, "root").select(F.col("node").alias("u"), "component_id")
    linked = others.join(named, "u")
    known = fps.join(linked, fps.fp == linked.u, "left").select(
        "fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(known, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with one row of each component: that with the smallest id, and of its texts that with the smallest checksum.

    A row is known by its id and its text (checksum and length), so an id that
    stands for several texts is judged by each of them.  Rows without an id stay, but
    rows that repeat both id and text are one document.
    """
    reserved(df)
    own, who = "__inkdex_key", [key, _SUM, _SIZE]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df_ = df.withColumns({own: F.col(key).cast("bigint"), _SUM: F.xxhash64(body), _SIZE: F.octet_length(body).cast("bigint")})
    rows = materialize(fingerprints(df_, key, text, (_SUM, _SIZE)), "fingerprints")
    this = F.struct(*who)
    fps = materialize(rows.groupBy("fp").agg(F.min(F.when(F.col(key).isNotNull(), this)).alias("least")), "distinct-fingerprints")
    roots = materialize(components(links(fps)), "roots")
    named = roots.join(fps, roots.node == fps.fp).groupBy("root").agg(F.min("least").alias("first"))
    named = roots.join(named, "root").select(F.col("node").alias("u"), "first")
    known = fps.join(named, fps.fp == named.u, "left").select("fp", F.coalesce("first", "least").alias("first"))
    gone = rows.join(known, "fp").where(F.col(key).isNotNull() & (this != F.col("first")))
    gone = materialize(gone.select(F.col(key).alias(own), _SUM, _SIZE).distinct(), "near-duplicates")
    kept = df_.join(small(gone, gone.count()), [own, _SUM, _SIZE], "left_anti")  # texts stay where they are if what goes is few
    repeats = rows.groupBy(*who).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = kept.dropDuplicates([own, _SUM, _SIZE]) if repeats.limit(1).count() else kept
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
