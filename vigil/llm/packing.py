"""Packing documents into sequences by Karmarkar-Karp differencing (operator 3).

Each document becomes its token ids and a final ``end`` id. Whole windows of
``window`` ids are cut off its front and are sequences of their own; the rest
is cut into pieces of at most ``window // 4``. Pieces are gathered, in the
order they come, into blocks of about ``BLOCK`` windows. A block is divided
into k = ceil(total / window) sequences by multiway differencing: every piece
starts as a partition with one used part; the two partitions with the largest
spread are merged, the largest part of one onto the smallest of the other,
until one is left, whose parts are nearly equal. If a part exceeds the window,
k rises by one and the block is divided again.

Tokenising and packing happen where the documents are read: nothing is
shuffled, a task holds one Arrow chunk and one block, and a lost task is
simply read again. A task leaves at most one partly filled block.

``sequence_id`` is the input partition and a running number. Null and empty
texts are a document of the end id alone. Null and repeated doc_ids and
repeated rows are separate documents. An empty table gives no rows; other
columns are ignored. A document of any length works: it is packed piece by
piece.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from array import array
from bisect import insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents

WINDOW = 1024
END_ID = 0
BLOCK = 128  # windows that one differencing divides


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str | None = None):
    """text -> ids of the byte-level BPE in ``path`` (a JSON file for
    ``tokenizers``), its added tokens included. The file for ``tiktoken`` beside
    it holds the same merges and pattern and gives the same ids (tested) in a
    third of the time."""
    import public_tokenizers
    import tiktoken
    path = str(path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    # a text is cut at the added tokens first, as tokenizers does by default
    return functools.partial(bpe.encode, allowed_special="all")


def differencing(sizes, k: int) -> list[list[int]]:
    """Members (indices) of k parts of nearly equal size. A partition is a list
    of (-size, part) in ascending order, so the largest part first; parts are
    nested pairs of indices, flattened at the end."""
    heap = [(-s, i, [(-s, i)]) for i, s in enumerate(sizes)]
    heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, x = heappop(heap)
        _, _, y = heappop(heap)
        if len(x) < len(y):
            x, y = y, x
        over = len(x) + len(y) - k
        if over <= 0:
            for part in y:
                insort(x, part, key=lambda p: p[0])
            spread = x[0][0] if len(x) < k else x[0][0] - x[-1][0]
        else:
            # the smallest ``over`` parts of both lie on each other, crosswise
            tail = x[len(x) - over:]
            fresh = [(a[0] + b[0], (a[1], b[1])) for a, b in zip(tail, reversed(y[len(y) - over:]), strict=True)]
            x = sorted(x[:len(x) - over] + y[:len(y) - over] + fresh, key=lambda p: p[0])
            low = x[-1][0]
            x = [(s - low, part) for s, part in x]
            spread = x[0][0]
        count += 1
        heappush(heap, (spread, count, x))
    parts = []
    for _, part in heap[0][2] if heap else []:
        members, stack = [], [part]
        while stack:
            p = stack.pop()
            if isinstance(p, tuple):
                stack.extend(p)
            else:
                members.append(p)
        parts.append(members)
    return parts


def divide(sizes, window: int) -> list[list[int]]:
    """Parts of at most ``window``: the part count rises until all fit."""
    k = -(-sum(sizes) // window)
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= window for p in parts):
            return parts
        k += 1


class Packer:
    """Packs the documents of one task; ``rows`` fills with finished pieces."""

    def __init__(self, window: int = WINDOW, block: int = BLOCK, first_id: int = 0):
        self.window, self.limit, self.next = window, block * window - block, first_id
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []
        self.total = 0

    def document(self, doc_id, ids: array) -> None:
        n, w = len(ids), self.window
        raw = ids.tobytes()  # little-endian unsigned 32-bit on the machines Spark runs on
        whole = n - n % w
        for a in range(0, whole, w):
            self.rows.append((doc_id, a, w, zlib.crc32(raw[4 * a:4 * (a + w)]), n, self.next, 0))
            self.next += 1
        most = max(1, w // 4)
        a = whole
        while a < n:
            size = min(most, n - a)
            if self.total + size > self.limit:
                size = self.limit - self.total  # cut so that the block is full
            if size:
                self.pieces.append((doc_id, a, size, zlib.crc32(raw[4 * a:4 * (a + size)]), n))
                self.total += size
                a += size
            if self.total >= self.limit:
                self.flush()

    def flush(self) -> None:
        if self.pieces:
            for part in divide([p[2] for p in self.pieces], self.window):
                at = 0
                for i in part:
                    self.rows.append((*self.pieces[i], self.next, at))
                    at += self.pieces[i][2]
                self.next += 1
        self.pieces, self.total = [], 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    def scan(batches):
        encode = byte_bpe(tokenizer_path)
        packer = Packer(window, block, TaskContext.get().partitionId() << 40)

        def done():
            rows, packer.rows = packer.rows, []
            cols = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

        for b in batches:
            for rows, _, _ in tb.text_chunks(b, "text"):
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = array("I", encode(text or ""))
                    ids.append(end_id)
                    packer.document(doc_id, ids)
                yield done()
        packer.flush()
        yield done()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
