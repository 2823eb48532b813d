"""Texts cut into blocks of bounded size, each with its distinct words and the texts as word numbers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text in a block; a single longer text is a block of its own.
BLOCK_BYTES = 8_000_000


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine: workers outlive their task, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Consecutive rows with about ``size`` bytes of text; the cut depends on the rows alone.

    The memory of a block is released before the next one is read.
    """
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, base + size - filled, side="left")) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            filled += int(ends[stop - 1] - base)
            start = stop
            if filled >= size:
                yield pa.Table.from_batches(held)
                held, filled = [], 0
                release()
    if held:
        yield pa.Table.from_batches(held)
    del held
    release()


def factorize(texts: pa.ChunkedArray, split=pc.ascii_split_whitespace) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in order of appearance, the word number at each place of the block, and the end of each text.

    Words are runs without the white space of ``split``, ASCII's by default. Text i holds the places from the end of text i - 1 to its own end.
    """
    pieces = split(texts.combine_chunks().cast(pa.large_string()))
    flat = pc.list_flatten(pieces)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # edges of a text give empty pieces
    ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
    kept = np.concatenate(([0], np.cumsum(real, dtype=np.int64)))
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), kept[ends]
