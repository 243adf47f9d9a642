"""Arrow batches of texts, in slices of bounded size, as numpy arrays.

Operators that run in Python get whole texts here, 64 kilobytes at a time: what is
made of them stays in the processor's cache, and a worker's memory does not depend
on how many rows Spark puts in a batch. When a task ends, its worker gives back what
it freed, as it lives on for the tasks of other operators.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 16


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run``, after whose last batch free memory goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def _text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, texts with null as empty); a slice has at most
    ``limit`` bytes unless it is a single row."""
    texts = _text_array(batch.column(column))
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, texts.slice(at, end - at)
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text and the end), offsets from 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each preceded and followed by one space; offsets)."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 2
    return points, np.concatenate([[0], np.cumsum(lengths)])
