"""Rows of an embedding table as numpy blocks, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def blocks(column: pa.Array):
    """(rows, matrix) for each vector length of an Arrow list column: the
    indices of its rows and their components in double precision. Null vectors
    and vectors that hold a null or a non-finite component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        at = start[rows][:, None] + np.arange(n)
        x = values[at.astype(np.int64)] if n else np.zeros((len(rows), 0))
        good = np.isfinite(x).all(axis=1)
        yield rows[good], x[good]


def packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    raw, width = np.ascontiguousarray(matrix), matrix.shape[1] * matrix.itemsize
    off = (np.arange(len(raw) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off), pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """The matrix whose rows ``packed`` wrote, all of ``width`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, width), kind)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind).reshape(len(column), width) if data is not None else np.zeros((len(column), width), kind)
