"""Vectorised word spans and hashes over the UTF-8 bytes of an Arrow column.

All text kernels of this package start from the same three steps: cut an Arrow
batch into chunks of bounded size, mark the bytes that belong to words, and
hash byte ranges. Everything is numpy over whole chunks; no Python loop runs
per word. A word hash multiplies each byte with a pseudo-random number of its
own place in the word and adds up modulo 2^64, then mixes; so which words
collide depends on those numbers, not on regular patterns, and equal words have
equal hashes in every task. Other seeds give independent hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_BLOCK = 512 << 10
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges) -> np.ndarray:
    """256 flags, true inside the given inclusive (first, last) ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, non-ASCII.
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NON_SPACE = ~byte_class([(0x09, 0x0D), (0x20, 0x20)])


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES,
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for slices of a batch with at most ``max_bytes``
    of text each (one longer text makes a slice of its own). Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Starts and ends (byte positions) of all maximal runs of word bytes, and
    the index of each text's first word (length: texts + 1)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = word[data]
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    inner = offsets[:-1][offsets[:-1] < len(m)]
    before[inner] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.lru_cache(maxsize=4)
def _factors(seed: int) -> np.ndarray:
    """The numbers of the first ``_BLOCK`` places."""
    return _factors_at(0, _BLOCK, seed)


def _factors_at(a: int, z: int, seed: int) -> np.ndarray:
    return mix64(np.arange(a + 1, z + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Sum modulo 2^64 of each range's values (plus one) times the numbers of
    their places. Work goes in blocks, so memory beyond the result is bounded."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    before = np.concatenate([[0], np.cumsum(size)])
    factors = _factors(seed)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _BLOCK, "right")) - 1)
        if size[i] > _BLOCK:  # one long range, piece by piece
            for k in range(0, int(size[i]), _BLOCK):
                piece = values[starts[i] + k:min(starts[i] + k + _BLOCK, ends[i])].astype(np.uint64) + np.uint64(1)
                out[i:i + 1] += (piece * _factors_at(k, k + len(piece), seed)).sum(dtype=np.uint64)
            i += 1
            continue
        first = before[i:j] - before[i]
        place = np.arange(before[j] - before[i]) - np.repeat(first, size[i:j])
        terms = (values[np.repeat(starts[i:j], size[i:j]) + place].astype(np.uint64) + np.uint64(1)) * factors[place]
        run = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=run[1:])
        out[i:j] = run[first + size[i:j]] - run[first]
        i = j
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each range of bytes (or of other numbers)."""
    return mix64(range_sums(data, starts, ends, seed) ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (over the whole chunk;
    the caller drops runs that cross a text's end)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x100000001B3 * 2 + 1)
        h += words[i:i + n]
    return mix64(h)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), values)


def project(batch: pa.RecordBatch, names) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
