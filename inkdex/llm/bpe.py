"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends it in the
piece's encoding by merges, and a token t ends the prefix p iff t's bytes end p
and t may follow the token that ends p without them.  Storing that last token for
each prefix encodes in one pass, makes appending exact, and confines the work
after an edit to its neighbourhood.

Defined cases: a null text is empty and has no ids; repeated rows are encoded
each; texts of any length are encoded whole; an empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import blocks
from inkdex.llm.common import ship
from inkdex.llm.tokens import Memo

MEMO_PIECES = 200_000
MEMO_PAIRS = 1_000_000
_loaded: dict[str, "Vocabulary"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks with the two parts that each token is merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.token[i] = raw
        self.left, self.right = [-1] * len(self.token), [-1] * len(self.token)
        for raw, i in ranks.items():
            if len(raw) > 1:
                self.left[i], self.right[i] = self._parts(raw, i)
        self.lengths: dict[bytes, tuple[int, ...]] = {}  # of the tokens of four bytes or more, by their last four
        for n in sorted({len(raw) for raw in ranks if len(raw) > 3}, reverse=True):
            for raw in ranks:
                if len(raw) == n and self.lengths.get(raw[-4:], (0,))[-1] != n:
                    self.lengths[raw[-4:]] = self.lengths.get(raw[-4:], ()) + (n,)
        self.lengths = {k: (*v, 3, 2, 1) for k, v in self.lengths.items()}
        self.pairs: dict[int, bool] = {}

    def _parts(self, raw: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what merges of lower rank leave of its bytes."""
        ranks, parts = self.ranks, [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return -1, -1  # no merge makes it: it can only stand for a whole piece
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves exactly these two tokens.

        The merges are undone from the last to the first; at no time may the
        tokens on the two sides of the boundary have had an earlier merge.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        token, ranks, left, right = self.token, self.ranks, self.left, self.right
        x, y, limit, fits = a, b, 1 << 60, len(token[b]) == 1 or left[b] >= 0
        while True:
            if ranks.get(token[x] + token[y], limit) < limit:
                fits = False
                break
            rx, ry = (x if right[x] >= 0 else -1), (y if left[y] >= 0 else -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = x, right[x]
            else:
                limit, y = y + 1, left[y]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits


class Prefixes:
    """Encoding of a growing or edited byte string that is merged as one piece."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", []
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self._extend(len(self.raw))

    def _extend(self, to: int) -> None:
        """Find the token that ends each further prefix, up to this length."""
        v, raw, last = self.vocabulary, self.raw, self.last
        get, pairs, lengths = v.ranks.get, v.pairs.get, v.lengths.get
        for end in range(len(last) + 1, to + 1):
            for n in lengths(raw[end - 4 : end], (3, 2, 1)) if end > 3 else range(end, 0, -1):
                start = end - n
                t = get(raw[start:end]) if start >= 0 else None
                if t is not None:
                    if not start:
                        fits = end == 1 or v.left[t] >= 0
                    else:
                        before = last[start - 1]
                        fits = pairs(before << 20 | t)
                        if fits is None:
                            fits = v.may_follow(before, t)
                    if fits:
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace raw[start:end]; returns how many prefixes were worked out again."""
        tail, worked, same = self.last[end:], 0, 0
        self.raw = self.raw[:start] + new + self.raw[end:]
        del self.last[start:]
        shift = start + len(new)
        for at in range(start + 1, len(self.raw) + 1):
            self._extend(at)
            worked += 1
            if at > shift:
                same = same + 1 if self.last[-1] == tail[at - shift - 1] else 0
                if same >= self.vocabulary.longest and at - shift >= self.vocabulary.longest:
                    self.last.extend(tail[at - shift :])
                    break
        return worked

    def turn_into(self, raw: bytes) -> list[int]:
        """Encode another string, keeping what it shares with this one."""
        del self.last[shared(self.raw, raw) :]
        self.raw = raw
        self._extend(len(raw))
        return self.ids()

    def ids(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class PieceMemo(Memo):
    """Piece of text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(MEMO_PIECES)
        self.vocabulary, self.state = vocabulary, Prefixes(vocabulary)

    def make(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        ids = self.state.turn_into(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in sorted order, so that each starts from the prefix it shares with the one before."""
        for piece in sorted(p for p in pieces if p not in self):
            self[piece]


class Codec:
    """Encodes and decodes texts by a rank file and the pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern)
        self.memo = PieceMemo(self.vocabulary)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        found = [self.pieces.findall(x) for x in texts]
        self.memo.learn(set().union(*found))
        return [b"".join(map(self.memo.__getitem__, x)) for x in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for the rank file."""
    if path not in _loaded:
        _loaded[path] = Codec(read_ranks(path), pattern)
    return _loaded[path]


def round_trip(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: (key, ids, decoded), both binary."""
    ship(df.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)

        for keys, texts in blocks(batches):
            ids = own.encode_all([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], schema=schema)

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(
        run, f"`{key}` bigint, ids binary, decoded binary")
