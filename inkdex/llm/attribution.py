"""Token counts by field and section, from one encoding of the whole document.

A document is its fields, joined by a separator that belongs to the field before
it; a field may be cut further into its lines.  The whole is encoded once, tokens
become spans of it, and the spans are joined to the sections' intervals.  A token
that crosses a boundary counts once, by the rule: ``majority`` gives it to the
section with most of its characters, the earlier on ties; ``first`` to the section
of its first character; ``last`` to that of its last.  A character counts as a
token's if any of its bytes does.

Defined cases: a null field is empty and still has a section; an empty document has
no tokens; a section without characters has none; repeated rows count each; texts of
any length are encoded whole; an empty table gives an empty result; columns other
than the key and the fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.arrow import Rows, as_bytes
from inkdex.llm.bpe import read_ranks
from inkdex.llm.common import ship

RULES = ("majority", "first", "last")
_loaded: dict[str, tuple] = {}


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """This process's encoder for the rank file, and the bytes of each token."""
    if path not in _loaded:
        ranks = read_ranks(path)
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for raw, i in ranks.items():
            sizes[i] = len(raw)
        _loaded[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path]


def sections(fields: list[tuple[str, bytes, bool]], separator: bytes) -> tuple[bytes, list[tuple[str, int]]]:
    """The whole document and (section, first byte) of its sections; fields are (name, text, whether to cut into lines)."""
    parts, found, at = [], [], 0
    for n, (name, text, lines) in enumerate(fields):
        if lines:
            first = 0
            for k, line in enumerate(text.split(b"\n")):
                found.append((f"{name}:{k}", at + first))
                first += len(line) + 1
        else:
            found.append((name, at))
        parts.append(text + separator if n + 1 < len(fields) else text)
        at += len(parts[-1])
    return b"".join(parts), found


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, whole: bytes, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, crossing tokens that touch it), for token byte spans and the sections' first bytes."""
    head = np.searchsorted(bounds, starts, side="right") - 1
    tail = np.searchsorted(bounds, ends - 1, side="right") - 1
    owner = (tail if rule == "last" else head).copy()
    crossing = np.zeros(len(bounds), dtype=np.int64)
    for t in np.flatnonzero(head != tail):
        pieces = []
        for s in range(head[t], tail[t] + 1):
            lo, hi = max(starts[t], bounds[s]), min(ends[t], bounds[s + 1] if s + 1 < len(bounds) else ends[t])
            if hi > lo:
                crossing[s] += 1
                while lo > 0 and whole[lo] & 0xC0 == 0x80:  # a character's first byte may be in the token before
                    lo -= 1
                pieces.append((-sum(b & 0xC0 != 0x80 for b in whole[lo:hi]), s))
        if rule == "majority":
            owner[t] = min(pieces)[1]
    return np.bincount(owner, minlength=len(bounds)), crossing


def count_tokens(
    df: DataFrame, ranks: str, pattern: str, fields: list[str], by_line: tuple[str, ...] = (), key: str = "doc_id", separator: str = "\n", rule: str = "majority"
) -> DataFrame:
    """(key, section, first_char, end_char, n_tokens, n_crossing, doc_tokens) for every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    ship(df.sparkSession)
    schema = pa.schema([
        (key, pa.int64()), ("section", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64()),
        ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(ranks, pattern)
        rows = Rows(schema)
        for batch in batches:
            columns = [as_bytes(batch.column(n + 1)) for n in range(len(fields))]
            for k, *texts in zip(batch.column(0).to_pylist(), *columns):
                whole, found = sections([(f, t, f in by_line) for f, t in zip(fields, texts)], separator.encode())
                ids = np.asarray(encoding.encode_ordinary(whole.decode("utf-8", "replace")), dtype=np.int64)
                ends = np.cumsum(sizes[ids])
                bounds = np.array([at for _, at in found], dtype=np.int64)
                tokens, crossing = allocate(ends - sizes[ids], ends, bounds, whole, rule)
                heads = np.zeros(len(whole) + 1, dtype=np.int64)
                np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, out=heads[1:])
                chars = [*heads[bounds].tolist(), int(heads[-1])]
                for n, (name, _) in enumerate(found):
                    rows.add(k, name, chars[n], chars[n + 1], int(tokens[n]), int(crossing[n]), len(ids), size=72)
                if rows.full:
                    yield rows.take()
        yield rows.take()

    chosen = df.select(F.col(key).cast("bigint").alias("_key"), *[F.col(f).cast("string").alias(f"_field{n}") for n, f in enumerate(fields)])
    return chosen.mapInArrow(run, f"`{key}` bigint, section string, first_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
