"""Whole Arrow columns of bytes as numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled by itself.
TOGETHER = 1 << 20


def parts(column: pa.Array, *beside: np.ndarray) -> Iterator[tuple]:
    """(bytes, offsets, slices of the arrays beside it) of runs of rows of a binary column; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + TOGETHER, "right")) - 1)
        yield data[at[k] : at[stop]], at[k : stop + 1] - at[k], *(b[k:stop] for b in beside)
        k = stop


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes out of one array."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())
