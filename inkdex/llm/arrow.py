"""Arrow helpers for the operators whose inner loops are in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Output of about this many bytes is handed back at a time, whatever the batch it came from.
FLUSH_BYTES = 8 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Rows:
    """Collects output rows and hands them back in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.size = schema, [[] for _ in schema], 0

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.size += size

    @property
    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema)]
        self.columns, self.size = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def per_row(batches: Iterable[pa.RecordBatch], schema: pa.Schema, each: Callable[..., None]) -> Iterator[pa.RecordBatch]:
    """Run ``each(rows, key, text)`` on every row of (key, text) batches; texts come as bytes."""
    rows = Rows(schema)
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            each(rows, key, text)
            if rows.full:
                yield rows.take()
    yield rows.take()


def blocks(batches: Iterable[pa.RecordBatch], size: int = FLUSH_BYTES // 4) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Cut (key, text) batches where their texts reach ``size`` bytes: (keys, texts as bytes) of each block."""
    for batch in batches:
        texts, first, held = as_bytes(batch.column(1)), 0, 0
        for at, text in enumerate(texts, 1):
            held += len(text)
            if held >= size or at == len(texts):
                yield batch.column(0).slice(first, at - first), texts[first:at]
                first, held = at, 0
