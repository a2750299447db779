"""Arrow plumbing shared by the operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id: int | None) -> bool | None:
    """Whether crc32(doc_id as text) mod 5 is 0; null for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5 == 0


def slices(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that long texts don't pile up."""
    for b in batches:
        n = max(1, min(b.num_rows, int(b.num_rows * size / max(1, b.nbytes))))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def mapper(rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield rows(b)

    return run
