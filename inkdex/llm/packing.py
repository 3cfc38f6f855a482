"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Bulk-synchronous best-fit.  Pieces are range-sorted by length; a superstep takes
the longest pieces not yet placed, finds for them the successor gap (the
smallest gap that holds them), resolves conflicts by rank (of pieces that want
the same gaps, the k-th in rank takes the k-th gap), updates the gaps and
repeats; what finds no gap opens sequences.

Lengths are integers of at most ``capacity``, so both sorted lists are runs of
equal sizes.  A sweep works on runs: an interval of ranks takes an interval of
gaps.  The run tables have at most ``capacity`` sizes, whatever the number of
documents; pieces stay distributed, are ranked inside their length by many
tasks, and look up their place in the table of matched intervals.

Defined cases: a null text is empty and holds only the end id; texts of any length are
encoded whole, their ids those of the library, which makes special tokens of their
strings in a text; a piece of
``capacity`` fills a sequence alone; repeated rows are packed separately; ties
are broken by key, start and then the sort's order; an empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkdex.llm.arrow import per_row
from inkdex.llm.common import materialize, ranked, ship, small
from inkdex.llm.tokens import words


def encode(df: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text with the end id, cut at ``capacity``: (key, piece, start, ids), ids little-endian uint32."""
    ship(df.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])
    end, step = struct.pack("<I", end_id), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(vocabulary)

        def each(rows, k, body: bytes) -> None:
            ids = memo.encode(body) + end
            for n, at in enumerate(range(0, len(ids), step)):
                rows.add(k, n, at // 4, ids[at : at + step], size=step)

        yield from per_row(batches, schema, each)

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{key}` bigint, piece int, start bigint, ids binary")


class Gaps:
    """Open sequences as runs: for each gap size, intervals of sequences that are filled alike."""

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.runs, self.next_sequence = capacity, [], {}, 0

    def put(self, size: int, first: int, count: int) -> None:
        if size and count:
            if size not in self.runs:
                insort(self.sizes, size)
                self.runs[size] = []
            self.runs[size].append((first, count))

    def successor(self, length: int) -> int | None:
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, size: int, most: int) -> tuple[int, int]:
        first, count = self.runs[size].pop()
        if count > most:
            self.runs[size].append((first + most, count - most))
            count = most
        if not self.runs[size]:
            del self.runs[size]
            self.sizes.pop(bisect_left(self.sizes, size))
        return first, count


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Match runs of pieces with runs of gaps: (length, first rank, end rank, first sequence, offset)."""
    gaps, placed = Gaps(capacity), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            size = gaps.successor(length)
            if size is not None:
                first, n = gaps.take(size, left)
                placed.append((length, rank, rank + n, first, capacity - size))
                gaps.put(size - length, first, n)
                rank, left = rank + n, left - n
            else:  # no gap holds this length: open as many sequences as the run fills
                each = capacity // length
                opened = -(-left // each)
                for k in range(each):
                    n = min(opened, left)
                    placed.append((length, rank, rank + n, gaps.next_sequence, k * length))
                    if n < opened:
                        gaps.put(capacity - k * length, gaps.next_sequence + n, opened - n)
                        opened = n
                    rank, left = rank + n, left - n
                    if not left:
                        gaps.put(capacity - (k + 1) * length, gaps.next_sequence, opened)
                        break
                gaps.next_sequence = max(gaps.next_sequence, max(p[3] + p[2] - p[1] for p in placed))
    return placed


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a materialized table of pieces with lengths from 1 to ``capacity``."""
    spark = pieces.sparkSession
    numbered, counts = ranked(pieces, length, capacity, order, "_rank")
    found = {r[0]: r[1] for r in counts.collect()}  # at most `capacity` rows
    if any(not 1 <= n <= capacity for n in found):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = sweep(found, capacity)
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("_length", T.LongType()), ("_from", T.LongType()), ("_to", T.LongType()), ("_sequence", T.LongType()), ("offset", T.LongType()))])
    places = small(spark.createDataFrame(plan, schema), len(plan))
    joined = numbered.join(places, (numbered[length] == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return joined.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")).drop("_length", "_from", "_to", "_sequence", "_rank")


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents: (key, piece, start, length, ids_crc32, sequence_id, offset).

    Token ids are checked and counted where they are made; only lengths and
    checksums travel on.  :func:`sequences` joins them to ids again.
    """
    pieces = encode(df, vocabulary, capacity, end_id, key, text).select(
        key, "piece", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"))
    placed = pack(materialize(pieces, "pieces"), capacity, [key, "piece", "start"])
    return placed.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids); a group holds at most ``capacity`` ids."""
    rows = placed.join(pieces.select(key, "piece", "ids"), [key, "piece"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return rows.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
