"""Benchmark decontamination by winnowing (operator 5).

A window is ``span`` consecutive words of a benchmark item; an item with fewer
words is one window as a whole. Words are lower-cased (A-Z) runs of digits,
a-z and non-ASCII characters.

1. Fingerprints: of every ``span - k + 1`` consecutive k-gram hashes the minimum
   is kept (all of its places on a tie). Any two equal runs of ``span`` words
   therefore share a kept k-gram at the same place in the run. An item of
   L < span words has one fingerprint, its L-gram, and documents then keep all
   L-grams of that length.
2. Join: document fingerprints meet benchmark fingerprints by hash. Before
   they leave the scan they pass a bit table of fixed size filled with the
   benchmark's fingerprints (no false negatives), so only candidates, with the
   words around them, reach the join; it needs no second scan. Fingerprints of
   both sides carry only the words that a window around them can hold (at most
   ``2 * span - k``), whatever the length of the item, and an item's equal
   fingerprints with equal words around them count once. The benchmark side is
   broadcast if its bytes, added up row by row, are few.
3. Extend: around each candidate the words themselves are compared at every
   offset at which a window can hold the k-gram.

Null and empty texts have no words and no hits. Ties, repeated rows and null
or repeated doc_id: every input row is followed by a row number of its own and
returned once. Items without words are ignored, repeated items (same item_id)
count once. An empty benchmark marks nothing; empty documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import broadcast_if_small, documents, text_digest, without, write_table

SPAN = 10
GRAM = 5
#: Size of the bit table: 2^24 bits, 2 MB in each task whatever the benchmark.
TABLE_BITS = 24

_PRINTS = pa.list_(pa.struct([("hash", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()), ("words", pa.list_(pa.string()))]))
_FOUND = pa.list_(pa.struct([("hash", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()),
                             ("first", pa.int32()), ("words", pa.list_(pa.string()))]))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Flags of the grams that are a minimum of some ``width`` in a row. Over a
    chunk of texts, windows that cross a text's end only add grams."""
    keep = np.zeros(len(grams), bool)
    n = len(grams) - width + 1
    if n > 0:
        least = grams[:n].copy()
        for i in range(1, width):
            np.minimum(least, grams[i:i + n], out=least)
        for i in range(width):
            keep[i:i + n] |= grams[i:i + n] == least
    return keep


def word_hashes(batch, column):
    for rows, data, off in tb.text_chunks(batch, column):
        low = tb.LOWER[data]
        starts, ends, first = tb.word_spans(low, off, tb.ALNUM)
        yield rows, low, starts, ends, first, tb.span_hashes(low, starts, ends)


def item_table(benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """item_id, number of words and fingerprints of every item, each with the
    words of all windows that hold it (``pos``: its place among these)."""
    def items(batches):
        for b in batches:
            for rows, low, starts, ends, first, h in word_hashes(b, "text"):
                prints = []
                for i in range(len(rows)):
                    a, z = first[i], first[i + 1]
                    size = k if z - a >= span else int(z - a)
                    grams = tb.gram_hashes(h[a:z], size) if size else h[:0]
                    at = np.flatnonzero(winnow(grams, span - k + 1)) if z - a >= span else range(len(grams))
                    found = {}
                    for p in at:
                        lo, hi = max(a, a + p - (span - size)), min(z, a + p + span)
                        around = tuple(low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True))
                        found[int(grams[p].view(np.int64)), int(a + p - lo), around] = size
                    prints.append([{"hash": g, "k": n, "pos": p, "words": w} for (g, p, w), n in found.items()])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(prints, _PRINTS)],
                    names=["item_id", "n_words", "prints"])
    table = benchmark.select("item_id", "text").mapInArrow(
        items, "item_id string, n_words long, prints array<struct<hash: long, k: int, pos: int, words: array<string>>>")
    return write_table(table.where("n_words > 0"), "benchmark")


def print_bytes() -> Column:
    """Size of a row of fingerprints in memory: words with their places in the
    array and padding, the item, and the other columns."""
    return F.octet_length(F.concat_ws("", "item_words")) + 16 * F.size("item_words") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 128


def bit_table(items: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The filled bit table; its size is fixed, whatever the benchmark's."""
    slot = F.shiftrightunsigned(F.col("p.hash"), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))
    filled = (items.select(F.explode("prints").alias("p")).select(F.shiftright(slot, 5).cast("int").alias("w"), bit.alias("b"))
              .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[filled["w"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64).astype(np.uint32)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def candidates(docs: DataFrame, table, short, span: int = SPAN, k: int = GRAM, digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, digest, n_words, and its fingerprints that
    may be in the benchmark, each with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        table = shared.value
        for b in batches:
            for rows, low, starts, ends, first, h in word_hashes(b, "text"):
                found = [[] for _ in range(len(rows))]
                for n in sorted({k, *short}):
                    grams = tb.gram_hashes(h, n)
                    if not len(grams):
                        continue
                    keep = np.ones(len(grams), bool) if n in short else winnow(grams, span - k + 1)
                    at = np.flatnonzero(keep)
                    at = at[in_table(table, grams[at])]
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + n <= first[doc + 1]
                    for p, d in zip(at[inside], doc[inside], strict=True):
                        lo = max(first[d], p - (span - n)) if n == k else p
                        hi = min(first[d + 1], p + span) if n == k else p + n
                        found[d].append({"hash": int(grams[p].view(np.int64)), "k": n, "pos": int(p - first[d]), "first": int(lo - first[d]),
                                         "words": [low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]})
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(first), pa.int64()), pa.array(found, _FOUND)],
                                                 names=["doc_id", "digest", "n_words", "found"])
    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), docs["text"]).mapInArrow(
        scan, "doc_id long, digest binary, n_words long, found array<struct<hash: long, k: int, pos: int, first: int, words: array<string>>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM, digest: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted item ids) and
    contaminated; with ``digest``, that column too."""
    items = item_table(benchmark, span, k)
    # lengths of the items that are shorter than a window: fewer than ``span`` numbers
    short = tuple(r[0] for r in items.where(F.col("n_words") < span).select("n_words").distinct().collect())
    table = bit_table(items)
    rows = write_table(candidates(docs, table, short, span, k, digest).withColumn("row", F.monotonically_increasing_id()), "winnowed")
    prints = items.select("item_id", F.explode("prints").alias("p")).select(
        "item_id", F.col("p.words").alias("item_words"), F.col("p.hash").alias("hash"), F.col("p.k").alias("k"), F.col("p.pos").alias("item_pos"))
    prints = broadcast_if_small(prints, print_bytes())
    met = (rows.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
           .join(prints, ["hash", "k"]))
    n_item = F.size("item_words")  # fewer than ``span`` only where the item is
    # before: words of the window that stand before the k-gram
    before = F.when(n_item < span, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(span) - F.col("k")))
    length = F.least(n_item, F.lit(span))
    tried = met.withColumn("before", F.explode(before)).withColumn("start", F.col("pos") - F.col("before")).where(
        (F.col("item_pos") >= F.col("before")) & (F.col("start") >= F.col("first"))
        & (F.col("item_pos") - F.col("before") + length <= n_item)
        & (F.col("start") - F.col("first") + length <= F.size("words")))
    window = lambda words, at: F.slice(words, (at + 1).cast("int"), length.cast("int"))
    hits = tried.where(window("words", F.col("start") - F.col("first")) == window("item_words", F.col("item_pos") - F.col("before")))
    hits = write_table(hits.select("row", "item_id", "start", length.alias("length")).distinct(), "window-hits")
    words = (hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    found = hits.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    extra = [] if digest is None else ["digest"]
    return (rows.select("row", "doc_id", "n_words", *extra).join(words, "row", "left").join(found, "row", "left")
            .select("doc_id", *extra, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those in benchmark windows, and the items."""
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark window; rows that share
    a doc_id (or have none) are told apart by their text."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), digest=text_digest(docs))
    return without(docs, write_table(found.where("contaminated").select("doc_id", "digest"), "contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wi AS (SELECT DISTINCT item, least(len(w), {SPAN}) AS n, unnest([w[p:p + least(len(w), {SPAN}) - 1]
       FOR p IN range(1, len(w) - least(len(w), {SPAN}) + 2)]) AS win FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wi),
wd AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, p, wd.n, item FROM wd JOIN wi ON wi.n = wd.n AND wi.win = wd.w[p:p + wd.n - 1]),
spots AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
"""
