"""Slices of Arrow batches as byte arrays, for tasks that work on text with numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; one longer text is still taken whole.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Yields ``(rows, bytes, offsets)`` for runs of rows of about ``limit`` bytes.

    ``rows`` is the slice of the batch, ``bytes`` a uint8 array and ``offsets`` the
    start of every text in it, with the end as last entry. A null text is empty.
    """
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(text))
        yield (
            batch.slice(first, last - first),
            whole[offsets[first] : offsets[last]],
            offsets[first : last + 1] - offsets[first],
        )
        first = last


def give_back() -> None:
    """Returns freed memory to the system: a worker serves one task after another."""
    pa.default_memory_pool().release_unused()
    # Only some C libraries keep freed memory and can be told to let it go.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(frames: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    for batch in frames:
        yield from text_slices(batch, column, limit)
    give_back()


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose cells are the stretches of ``data`` between byte ``offsets``."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )
