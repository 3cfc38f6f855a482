"""Removal of byte strings that occur more than once, by merged Burrows-Wheeler transforms.

A document's windows are its strings of ``length`` bytes.  Each window is owned
by the smallest hash of its shorter grams (the leftmost on ties), so equal windows
have equal owners, and consecutive windows with one owner form a segment of at
most ``2 * length`` bytes.  Segments are counted by the digest of their contents: a
segment found twice repeats as a whole, one whose owner is found once repeats nowhere.
What is left are owners with unequal contents.  Their contents are brought
together by owner; each task holds them in shards, sorts each shard's suffixes
once, and merges the shards' transforms by refining their interleave: after h
rounds it is in the order of the first h symbols, and the blocks between the
boundaries found so far are the suffixes with h common symbols.  After
``length / symbol`` rounds, the blocks of two and more are the repeated windows; no
suffix of another shard is ever compared or sorted again.  A symbol is a gram of
up to 25 bytes.

Nothing rests on a hash that texts could be made to collide in.  Texts and segments
are known by 128 bits of SHA-256 and BLAKE2b.  Symbols get their codes by a fast hash,
and each is then compared, byte by byte, with the first that has its code; should any
differ, the codes come from sorting the symbols themselves.  Owners only bring
windows together: unequal windows with one owner cost time, never a wrong answer.

A task holds at most ``CROWD`` different contents of an owner, which bounds its
memory.  The windows of larger owners are spread over all tasks: those that
are alone by a fast hash are dropped, the others are counted by their digests.

Rows that repeat a text are counted before anything is listed or joined by text,
and texts held by more than a ``HEAVY``-th (50,000th) of all rows never meet in one task.

Defined cases: a null text is empty; texts shorter than ``length`` stay; texts of any
length are read whole, in overlapping stretches; a repeated row is a document like any
other, so all of it repeats; rows may share an id or have none; an empty table
gives an empty result; further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import Rows, as_bytes
from inkdex.llm.common import heavy, materialize, release, reserved, ship

U = np.uint64
STRETCH = 1 << 17  # bytes whose windows are worked out at a time
LOW = U((1 << 18) - 1)
BASE = 0xD6E8FEB86659FD93
CROWD = 8_000
CHUNK = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, for one stretch."""
    inverse = pow(BASE, -1, 1 << 64)
    ones = np.ones(STRETCH + 1, dtype=U)
    out = []
    for base in (BASE, inverse):
        steps = ones * U(base)
        steps[0] = U(1)
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(32))) * U(0x9FB21C651E98DF25)
    z = (z ^ (z >> U(29))) * U(0xBF58476D1CE4E5B9)
    return z ^ (z >> U(32))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte times power; differences are hashes of substrings."""
    out = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * _powers()[0][: len(raw)], out=out[1:])
    return out


def grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the gram of this size at each position."""
    return mix((sums[size:] - sums[:-size]) * _powers()[1][: len(sums) - size])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def gram_size(length: int) -> int:
    return max(1, min(32, length // 3))


def digests(bodies: list[bytes]) -> np.ndarray:
    """128-bit digests, a row of two signed 64-bit numbers for each string."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in bodies]), np.int64).reshape(-1, 2)


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, owner, contents) of each segment: the owner's 64-bit hash and the contents' digest."""
    k = gram_size(length)
    parts = []
    for at in range(0, max(1, len(text) - length + 1), STRETCH - length + 1):
        raw = np.frombuffer(text, np.uint8, count=min(STRETCH, len(text) - at), offset=at)
        hashes = grams(prefix_sums(raw), k)
        key = (hashes & ~LOW) | np.arange(len(hashes), dtype=U)
        owner = sliding_min(key, length - k + 1)
        cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
        contents = digests([text[lo:hi] for lo, hi in zip((first + at).tolist(), (last + at + length).tolist())])
        parts.append((first + at, last - first + 1, hashes[(owner[first] & LOW).astype(np.int64)].view(np.int64), contents))
    return tuple(np.concatenate(x) for x in zip(*parts))


def symbol_size(length: int) -> int:
    return max(q for q in range(1, 26) if length % q == 0)


def _order(codes: np.ndarray) -> np.ndarray:
    """Stable order of non-negative codes below 2^32, by two passes over 16 bits."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Shard:
    """Strings with the order of their suffixes and the symbols before them (the transform).

    A string's suffixes form ``symbol`` chains, each suffix followed by that one
    symbol later; a chain is closed to a ring, so every suffix has one before it.
    """

    def __init__(self, bodies: list[bytes], length: int):
        q = symbol_size(length)
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        total = len(raw)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        here = np.arange(total, dtype=np.int32)
        offset = here - np.repeat(self.starts[:-1].astype(np.int32), sizes)
        left = np.repeat(sizes.astype(np.int32), sizes) - offset
        self.window = left >= length
        hashes = np.zeros(total, dtype=U)
        for at in range(0, total, STRETCH - q + 1):
            part = raw[at : at + STRETCH]
            if len(part) >= q:
                hashes[at : at + len(part) - q + 1] = grams(prefix_sums(part), q)
        hashes[left < q] = U(0)
        self.next = np.where(left > q, here + q, here - offset + offset % q)
        self.before = np.empty_like(here)
        self.before[self.next] = here
        self.raw, self.full, self.hashes = raw, left >= q, hashes

    def sort(self, codes: np.ndarray, depth: int) -> None:
        """Order the suffixes by at least ``depth`` symbols."""
        rank, known, to = codes.astype(np.int64), 1, self.next
        while known < depth:
            pair = rank * (int(rank.max()) + 1) + rank[to]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64, copy=False)
            known, to = 2 * known, to[to]
        self.order = _order(rank).astype(np.int32)
        self.transform = codes[self.before[self.order]]


def merge(a: Shard, b: Shard, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of two transforms: (which suffix comes from b, the block of each), after ``depth`` rounds."""
    from_b = np.zeros(len(a.order) + len(b.order), dtype=bool)
    from_b[len(a.order) :] = True
    block = np.zeros(len(from_b), dtype=np.int32)
    symbols = np.empty(len(from_b), dtype=a.transform.dtype)
    for _ in range(depth):
        symbols[~from_b], symbols[from_b] = a.transform, b.transform
        to = _order(symbols)
        from_b, block, s = from_b[to], block[to], symbols[to]
        new = np.zeros(len(to), dtype=np.int32)
        new[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
    return from_b, block


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; bytes beyond the end are zero."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw), dtype="<u8", buffer=padded.data, strides=(1,))


def _symbols(raw: np.ndarray, full: np.ndarray, hashes: np.ndarray, q: int) -> np.ndarray:
    """Codes of the symbols of ``q`` bytes at all positions; equal codes are equal symbols.  Positions that aren't full share a code."""
    _, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    model = first[codes]
    same = full == full[model]
    if q < 8:
        for k in range(q):
            byte = np.concatenate([raw[k:], np.zeros(k, np.uint8)])
            same &= (byte == byte[model]) | ~full
    else:
        words = _words(raw)
        for k in {*range(0, q - 7, 8), q - 8}:  # eights that cover the symbol
            word = np.concatenate([words[k:], np.zeros(k, words.dtype)])
            same &= (word == word[model]) | ~full
    if same.all():
        return codes.astype(np.uint32)
    codes = full.astype(np.int64)  # two symbols share a hash: code them by their bytes
    for k in range(q):
        byte = np.concatenate([raw[k:], np.zeros(k, np.uint8)])
        codes = np.unique(codes * 256 + np.where(full, byte, 0), return_inverse=True)[1].astype(np.int64)
    return codes.astype(np.uint32)


def repeated(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows occur at two or more places in the strings."""
    halves = [bodies[0::2], bodies[1::2] or [b""]]
    a, b = (Shard(x, length) for x in halves)
    both = [np.concatenate(x) for x in ((a.raw, b.raw), (a.full, b.full), (a.hashes, b.hashes))]
    codes = _symbols(*both, symbol_size(length))
    depth = length // symbol_size(length)
    a.sort(codes[: len(a.hashes)], depth)
    if len(b.hashes):
        b.sort(codes[len(a.hashes) :], depth)
    else:
        b.order, b.transform = np.zeros(0, np.int32), np.zeros(0, np.uint32)
    from_b, block = merge(a, b, depth)
    window = np.empty(len(block), dtype=bool)
    window[~from_b], window[from_b] = a.window[a.order], b.window[b.order]
    often = np.bincount(block[window], minlength=int(block[-1]) + 1 if len(block) else 0)[block] > 1
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(bodies)
    for which, (shard, mine) in enumerate(((a, often[~from_b]), (b, often[from_b]))):
        found = np.empty(len(mine), dtype=bool)
        found[shard.order] = mine
        found &= shard.window
        for n, body in enumerate(halves[which]):
            if body:
                out[2 * n + which] = found[shard.starts[n] : shard.starts[n] + len(body) - length + 1]
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans covered by overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_SPAN = "text binary, lo int, hi int"
_BODY = "text binary, at int, owner bigint, single boolean, body binary"


def text_id(body: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(body, 256), 1, 32))


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """(text, at, n, owner, c1, c2): the segments of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            for n, text in enumerate(as_bytes(batch.column(1))):
                if len(text) >= length:
                    parts.append(segments(text, length))
                    rows.append(np.full(len(parts[-1][0]), n))
            if parts:
                at, n, owner, contents = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(owner),
                     pa.array(np.ascontiguousarray(contents[:, 0])), pa.array(np.ascontiguousarray(contents[:, 1]))],
                    names=["text", "at", "n", "owner", "c1", "c2"])

    return docs.mapInArrow(run, "text binary, at int, n int, owner bigint, c1 bigint, c2 bigint")


def _fetch(packed: DataFrame, wanted: DataFrame, often: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (text, at, n, owner, single)."""
    lists = wanted.groupBy("text").agg(F.collect_list(F.struct("at", "n", "owner", "single")).alias("wanted"))
    texts = packed.where("size >= %d" % length).select("text", "packed")
    one = texts.join(often, "text").groupBy("text").agg(F.min("packed").alias("packed"))  # of texts that many rows hold
    joined = texts.join(often, "text", "left_anti").unionByName(one).join(lists, "text")
    schema = pa.schema([("text", pa.binary()), ("at", pa.int32()), ("owner", pa.int64()), ("single", pa.bool_()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, unpack, last = Rows(schema), zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            for name, z, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if name == last:
                    continue
                text, last = unpack(z), name
                for w in wanted:
                    body = text[w["at"] : w["at"] + w["n"] + length - 1]
                    rows.add(name, w["at"], w["owner"], w["single"], body, size=len(body))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return joined.select("text", "packed", "wanted").mapInArrow(run, _BODY)


def _merged(bodies: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of single contents; all contents of an owner are in one task."""
    schema = pa.schema([("text", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def settle(rows: Rows, held: list[tuple]) -> None:
        flags = repeated([h[4] for h in held], length)
        for (text, at, _, single, _), flag in zip(held, flags):
            if single:
                for first, end in runs(flag):
                    rows.add(text, at + first, at + end - 1 + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size, owner = Rows(schema), [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] != owner and size >= CHUNK:
                    settle(rows, held)
                    held, size = [], 0
                owner = row[2]
                held.append(row)
                size += len(row[4])
            if rows.full:
                yield rows.take()
        if held:
            settle(rows, held)
        yield rows.take()

    near = bodies.repartition("owner").sortWithinPartitions("owner")
    return near.mapInArrow(run, _SPAN)


def _counted(bodies: DataFrame, length: int) -> DataFrame:
    """The same for owners with a crowd of contents: windows are rows, spread over all tasks."""

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [grams(prefix_sums(np.frombuffer(body, np.uint8)), length).view(np.int64) for body in part.column(4).to_pylist()]
                index = np.repeat(np.arange(len(found)), [len(x) for x in found])
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(place), pa.array(np.concatenate(found))], names=["text", "at", "place", "w"])

    def by_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, index, places = [], [], []
            for n, (at, body, alike) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                found += [body[p : p + length] for p in alike]
                index += [n] * len(alike)
                places += [at + p for p in alike]
            if found:
                take, d = pa.array(index), digests(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(places, pa.int32()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))],
                    names=["text", "single", "lo", "d1", "d2"])

    windows = materialize(bodies.mapInArrow(by_hash, "text binary, at int, place int, w bigint"), "windows")
    often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("w")
    alike = windows.join(often, "w").groupBy("text", "at").agg(F.collect_list("place").alias("alike"))
    digested = bodies.join(alike, ["text", "at"]).select("text", "at", "single", "body", "alike")
    digested = materialize(digested.mapInArrow(by_digest, "text binary, single boolean, lo int, d1 bigint, d2 bigint"), "window-digests")
    often = digested.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("d1", "d2")
    return digested.where("single").join(often, ["d1", "d2"]).select("text", "lo", (F.col("lo") + length).alias("hi"))


def _prepared(df: DataFrame, text: str) -> DataFrame:
    """(text, body): a text's id and the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(text_id(body).alias("text"), body.alias("body"))


def often_held(df: DataFrame, length: int, text: str) -> DataFrame:
    """(text): ids of the texts of ``length`` bytes and more that are held by more than one row and by over a HEAVY-th of them all; fewer than HEAVY."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = df.where(F.octet_length(body) >= length).groupBy(text_id(body).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return heavy(materialize(counts.where("copies > 1"), "repeated-texts"), "copies").select("text")


def repeated_spans(docs: DataFrame, packed: DataFrame, often: DataFrame, length: int, crowd: int = CROWD) -> DataFrame:
    """(text, found): the spans [lo, hi) of each text (by id) that lie in repeated windows; spans may overlap."""
    rows = materialize(_segment_rows(docs, length), "segments")
    same = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.first("owner").alias("owner"))
    owners = same.groupBy("owner").agg(
        F.sum("copies").alias("places"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("singles")).where("places > 1")
    known = same.join(owners, "owner").select(
        "c1", "c2", "copies", F.when((F.col("kinds") > 1) & (F.col("singles") > 0), F.col("kinds")).alias("kinds"))
    known = materialize(known, "known-segments")
    most = heavy(known, "copies", rows.count())  # a segment that many rows hold is joined where they are
    hits = rows.join(most, ["c1", "c2"]).unionByName(
        rows.join(most, ["c1", "c2"], "left_anti").join(known.join(most, ["c1", "c2"], "left_anti"), ["c1", "c2"]))
    hits = materialize(hits, "segment-hits")
    release(rows)
    release(known)
    whole = hits.where("copies > 1").select("text", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (length - 1)).alias("hi"))
    open_ = hits.where("kinds is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("text", "at", "n", "owner")).alias("r"), F.first(F.col("copies") == 1).alias("single"), F.first("kinds").alias("kinds"))
    open_ = materialize(open_.select("r.*", "single", (F.col("kinds") > crowd).alias("crowded")), "open-segments")
    spans = whole.unionByName(_merged(_fetch(packed, open_.where("not crowded"), often, length), length))
    if open_.where("crowded").limit(1).count():
        spans = spans.unionByName(_counted(materialize(_fetch(packed, open_.where("crowded"), often, length), "crowded-bodies"), length))
    spans = spans.groupBy("text").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))  # a text held by many rows lists its spans once
    spans = materialize(spans, "spans")
    release(hits)
    release(open_)
    return spans


def pack_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, size, packed): texts' ids, sizes, and the texts compressed, which are smaller to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            bodies = as_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) for b in bodies], pa.int64()), pa.array(map(squeeze, bodies), pa.binary())],
                names=["key", "text", "size", "packed"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("bigint").alias("key"), text_id(body).alias("text"), body.alias("body"))
    return rows.mapInArrow(run, "key bigint, text binary, size bigint, packed binary")


def _with_spans(rows: DataFrame, spans: DataFrame, often: DataFrame, length: int, id_: str, size: str, into: str) -> DataFrame:
    """Rows with the spans of their texts (null: none), joined by id; short and heavy texts need no join."""
    flag = "__inkdex_often"
    flagged = rows.join(often.select(F.col("text").alias(id_), F.lit(True).alias(flag)), id_, "left")
    simple = F.col(flag).isNotNull() | (F.col(size) < length)
    all_ = F.when(F.col(size) >= length, F.array(F.struct(F.lit(0).alias("lo"), F.col(size).cast("int").alias("hi"))))
    listed = spans.select(F.col("text").alias(id_), F.col("found").alias(into))
    return flagged.where(simple).withColumn(into, all_).unionByName(flagged.where(~simple).join(listed, id_, "left")).drop(flag)


def remove_repeats(df: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(key, n_bytes, spans, kept) of every document: the maximal removed spans and the bytes that are left."""
    ship(df.sparkSession)
    packed, often = materialize(pack_texts(df, key, text), "packed"), often_held(df, length, text)
    spans = repeated_spans(_prepared(df, text), packed, often, length, crowd)
    joined = _with_spans(packed, spans, often, length, "text", "size", "found")
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, unpack = Rows(schema), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, z, found in zip(*(c.to_pylist() for c in batch.columns)):
                body = unpack(z)
                gone = union_spans([(s["lo"], s["hi"]) for s in found or ()])
                at, left = 0, []
                for lo, hi in gone:
                    left.append(body[at:lo])
                    at = hi
                left.append(body[at:])
                rows.add(k, len(body), [{"lo": lo, "hi": hi} for lo, hi in gone], b"".join(left), size=len(body) + 64)
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return joined.select("key", "packed", "found").mapInArrow(
        run, f"`{key}` bigint, n_bytes bigint, spans array<struct<lo: bigint, hi: bigint>>, kept binary")


def cut_repeats(df: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", count: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with the repeated strings cut out of their texts, and ``count`` set to what is left, in its columns.

    Bytes of a character of which another part was cut go too.  Rows whose text
    has no repeats keep it as it is, null included; none is dropped.
    """
    ship(df.sparkSession)
    reserved(df)
    often = often_held(df, length, text)
    packed = materialize(pack_texts(df, key, text), "packed")
    spans = repeated_spans(_prepared(df, text), packed, often, length)
    release(packed)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.withColumns({"__inkdex_id": text_id(body), "__inkdex_size": F.octet_length(body)})
    rows = _with_spans(rows, spans, often, length, "__inkdex_id", "__inkdex_size", "__inkdex_found")
    names = df.columns
    at, found, counted = names.index(text), len(names), names.index(count) if count in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:found]
            texts, gone = columns[at].to_pylist(), batch.column(found).to_pylist()
            changed = [n for n, spans in enumerate(gone) if spans]
            if changed:
                for n in changed:
                    raw, end, left = texts[n].encode(), 0, []
                    for lo, hi in union_spans([(s["lo"], s["hi"]) for s in gone[n]]):
                        left.append(raw[end:lo].decode("utf-8", "ignore"))
                        end = hi
                    left.append(raw[end:].decode("utf-8", "ignore"))
                    texts[n] = "".join(left)
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    sizes = columns[counted].to_pylist()
                    for n in changed:
                        sizes[n] = len(texts[n])
                    columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*[F.col(f"`{c}`") for c in names], "__inkdex_found").mapInArrow(run, df.schema)
