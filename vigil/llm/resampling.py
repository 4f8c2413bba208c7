"""Importance resampling towards a target corpus (operator 11).

Features are all runs of 1 to 3 consecutive words; a feature's bucket is the
crc32 of its bytes modulo ``BUCKETS``. A document's weight is the sum of its
features' gains, where a bucket's gain is the floored, scaled log-ratio of its
smoothed share in the target corpus and in all documents. Adding Gumbel noise
drawn from a hash of doc_id and keeping the highest scores draws without
replacement in proportion to the exponentials of the weights.

1. Array-scored weights: each task counts buckets into one array; the summed
   counts give one array of gains, and a second scan adds up the gains of whole
   Arrow chunks. The crc32 of a run is put together from those of its words
   (crc32 is linear over GF(2)), so no feature string is ever built.
2. Parallel sorting by regular sampling: every task writes its rows as a
   sorted run. Each run gives rows at regular positions (the stride doubles
   when there are too many, so memory stays bounded), and these give the
   splitters. Rows are counted per segment; only the segments that hold drawn
   ranks are exchanged, each is sorted by itself, and the prefix counts of the
   segments before it make its row numbers exact ranks.

Null and empty texts have no features: weight 0, and never drawn. Null doc_ids
draw their noise from the key ``<seed>:`` and lose ties; rows that tie in score
and doc_id are drawn in the order of their scan. Repeated rows are rows of
their own. No documents give no rows; an empty target leaves all gains to the
smoothing. Long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents, write_table

BUCKETS = 10_000
RUN_WORDS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Sampled rows of all runs together that choose the splitters (twice as many at most).
SAMPLES = 1 << 18

_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_SHORT = 64


def _then_zero(crc: np.ndarray) -> np.ndarray:
    """The linear part of crc32 after one more byte of zero."""
    return _STEP[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given as its values for each byte of the argument."""
    out = table[0][crc & np.uint32(255)]
    for i in (1, 2, 3):
        out ^= table[i][(crc >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _shift_tables():
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    by_length, powers = [one], []
    for _ in range(_SHORT):
        by_length.append(_then_zero(by_length[-1]))
    powers.append(by_length[1])
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(by_length), np.stack(powers)


_BY_LENGTH, _POWERS = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 carried over ``length`` following bytes: the crc32 of a + b is
    shifted(crc32(a), len(b)) ^ crc32(b)."""
    flat = _BY_LENGTH.reshape(-1)
    at = np.minimum(length, _SHORT).astype(np.int64) * 1024
    out = flat[at + (crc & np.uint32(255))]
    for i in (1, 2, 3):
        out ^= flat[at + 256 * i + ((crc >> np.uint32(8 * i)) & np.uint32(255))]
    for w in np.flatnonzero(length > _SHORT):  # words this long are rare
        c, rest = out[w:w + 1], int(length[w]) - _SHORT
        for j in range(rest.bit_length()):
            if rest >> j & 1:
                c = _apply(_POWERS[j], c)
        out[w] = c[0]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each byte range, one byte of all ranges at a time."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    at, left = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(_SHORT):
        n = int(np.searchsorted(-left, -i, "left"))  # ranges of more than i bytes come first
        if n == 0:
            break
        c = crc[:n]
        crc[:n] = _STEP[(c ^ data[at[:n] + i]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for w in np.flatnonzero(size > _SHORT):
        out[w] = zlib.crc32(data[starts[w]:ends[w]])
    return out


def run_buckets(data, starts, ends, first, buckets: int = BUCKETS, run_words: int = RUN_WORDS):
    """For each run length from 1: the buckets of the runs that begin at each
    word, and which of them end inside their text. ``first`` marks the texts."""
    size = ends - starts
    word = word_crcs(data, starts, ends)
    last = np.repeat(first[1:], np.diff(first))  # index behind the word's text
    index = np.arange(len(word))
    spaced = shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), size) ^ word  # " " + word
    crc = word
    for n in range(1, run_words + 1):
        if n > 1:
            crc = shifted(crc[:-1], size[n - 1:] + 1) ^ spaced[n - 1:] if len(crc) else crc
        yield (crc % np.uint32(buckets)).astype(np.int64), index[:len(crc)] + n <= last[:len(crc)]


def _chunks(batches):
    for b in batches:
        for rows, data, off in tb.text_chunks(b, "text"):
            low = tb.LOWER[data]
            yield rows, (low, *tb.word_spans(low, off, tb.ALNUM))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run_words: int = RUN_WORDS) -> np.ndarray:
    """How many features of all rows of ``texts`` fall into each bucket."""
    def count(batches):
        n = np.zeros(buckets, np.int64)
        for _, spans in _chunks(batches):
            for bucket, inside in run_buckets(*spans, buckets, run_words):
                n += np.bincount(bucket[inside], minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit])], names=["bucket", "n"])
    total = np.zeros(buckets, np.int64)
    # at most ``buckets`` rows reach the driver
    for r in texts.select(texts["text"]).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in target over source."""
    n = len(source)
    over, under = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log(((t + 1) * over) / ((s + 1) * under)))
                     for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run_words: int = RUN_WORDS) -> DataFrame:
    """Per row: doc_id, n_features, n_words and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def weigh(batches):
        gain = shared.value
        for rows, (low, starts, ends, first) in _chunks(batches):
            words = np.diff(first)
            weight, features = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for n, (bucket, inside) in enumerate(run_buckets(low, starts, ends, first, len(gain), run_words)):
                run = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(np.where(inside, gain[bucket], 0), out=run[1:len(bucket) + 1])
                run[len(bucket) + 1:] = run[len(bucket)]
                weight += run[first[1:]] - run[first[:-1]]
                features += np.maximum(words - n, 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(features), pa.array(words.astype(np.int64)), pa.array(weight)],
                                             names=["doc_id", "n_features", "n_words", "weight"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        weigh, "doc_id long, n_features long, n_words long, weight long")


def gumbel(doc_id, seed: int = SEED):
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256("seed:id")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _order():
    return F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")


def _keys(batch: pa.RecordBatch):
    """The columns of the order as integers that ascend."""
    score, doc, row = (batch.column(batch.schema.get_field_index(c)) for c in ("score", "doc_id", "row"))
    return (-score.to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
            doc.fill_null(0).to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False))


def run_samples(runs: DataFrame, each: int) -> DataFrame:
    """Rows at regular positions of every sorted run, between ``each`` and
    twice as many of a run that has them, with the rows that one stands for."""
    def sample(batches):
        stride, seen = 1, 0
        kept = np.zeros((5, 0), np.int64)  # position and key
        for b in batches:
            at = np.arange(seen, seen + b.num_rows)
            new = np.stack([at, *_keys(b)])[:, at % stride == 0]
            seen += b.num_rows
            kept = np.concatenate([kept, new], axis=1)
            while kept.shape[1] > 2 * each:
                stride *= 2
                kept = kept[:, kept[0] % stride == 0]
        if seen:
            stands = np.minimum(stride, seen - kept[0])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*kept[1:], stands)], names=["a", "b", "c", "d", "stands"])
    return runs.select("score", "doc_id", "row").mapInArrow(sample, "a long, b long, c long, d long, stands long")


def splitters(samples: np.ndarray, stands: np.ndarray, wanted: int, parts: int) -> np.ndarray:
    """Keys (columns) that cut the order into ``parts`` segments up to about
    rank ``wanted`` and as many behind it."""
    order = np.lexsort(samples[::-1])
    before = np.cumsum(stands[order]) - stands[order]
    total = int(stands.sum())
    near = min(total, wanted + wanted // 10 + total // (4 * parts))
    cuts = np.unique(np.concatenate([np.linspace(0, near, parts + 1), np.linspace(near, total, parts + 1)]))[1:-1]
    at = np.unique(np.searchsorted(before, cuts))
    return samples[:, order[at[at < len(order)]]]


def segment_numbers(keys, cuts: np.ndarray) -> np.ndarray:
    """How many of the splitters are at or before each key."""
    n, k = len(keys[0]), cuts.shape[1]
    both = [np.concatenate([c, key]) for c, key in zip(cuts, keys, strict=True)]
    order = np.lexsort(both[::-1])  # stable: a splitter comes before its own row
    is_cut = order < k
    out = np.empty(n + k, np.int64)
    out[order] = np.cumsum(is_cut)
    return out[k:]


def exact_ranks(runs: DataFrame, eligible, wanted: int, samples: int = SAMPLES) -> DataFrame:
    """``runs`` (score, doc_id, a unique row, each input partition sorted) with
    rank 1 to ``wanted`` by score, highest first, null elsewhere and where
    ``eligible`` does not hold."""
    spark = runs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = runs.where(eligible)
    each = max(1, samples // max(1, chosen.rdd.getNumPartitions()))
    # bounded by ``samples`` and the number of runs, whatever the rows
    got = run_samples(chosen, each).toPandas().to_numpy(np.int64).T.reshape(5, -1)
    shared = spark.sparkContext.broadcast(splitters(got[:4], got[4], wanted, parts))

    def place(batches):
        cuts = shared.value
        for b in batches:
            if b.num_rows:
                seg = pa.array(segment_numbers(_keys(b), cuts).astype(np.int32))
                kept = b.column(b.schema.get_field_index("_chosen")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.where(kept, seg, -1).astype(np.int32))],
                                                 names=[*b.schema.names[:-1], "segment"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields]
    placed = write_table(runs.withColumn("_chosen", F.coalesce(eligible, F.lit(False))).mapInArrow(place, ", ".join([*fields, "segment int"])), "segments")

    counts = sorted((r["segment"], r["n"]) for r in placed.where("segment >= 0").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for s, n in counts:  # at most two numbers for each shuffle partition
        if before < wanted:
            offsets.append((s, before))
        before += n
    last = offsets[-1][0] if offsets else -1
    near = placed.where((F.col("segment") >= 0) & (F.col("segment") <= last)).join(
        F.broadcast(spark.createDataFrame(offsets, "segment int, _before long")), "segment")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    near = near.select(*runs.columns, rank.cast("long").alias("rank")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = placed.where((F.col("segment") < 0) | (F.col("segment") > last))
    return near.unionByName(rest.select(*runs.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, n_words, weight, score and the
    rank of the drawn ones: ``percent`` % of the rows with ``min_words`` words."""
    gain = gains(bucket_counts(target), bucket_counts(docs))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    runs = write_table(scored.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(*_order()), "scores")
    eligible = F.col("n_words") >= min_words
    wanted = percent * runs.where(eligible).count() // 100
    return exact_ranks(runs, eligible, wanted).drop("row")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score, and the rank of the drawn 5 %."""
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
