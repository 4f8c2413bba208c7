"""Quality by compression (operator 8).

Two zstandard dictionaries are built from a bounded sample of labelled texts,
one from good and one from bad ones: whole texts are cut into pieces, and of the
pieces, wherever in a text they stand, a hash takes ``SAMPLE_PIECES`` of a kind. A text is compressed with both; the
difference of the compressed sizes, normalised by the text's size and by the
compressed sizes, says which kind it resembles. A logistic fit, which is also
told how well the text compresses at all (endless repetition shrinks to nothing
with either dictionary), turns it into a probability of label 1. The fit sees
only texts that did not go into the dictionaries.

Texts longer than ``PIECE`` bytes are compressed piece by piece, whole, so
that the dictionary, which helps most at a text's start, counts alike in long
and short texts.

Null and empty texts score the sample's base rate. Without labels of both
kinds every text does. Repeated rows and null or repeated doc_ids are scored
row by row; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents
from .labelled import TRAIN_ROWS, fit_logistic, is_fold, labelled_texts, logistic

PIECE = 2048               # bytes compressed at once
DICTIONARY = 110 << 10     # bytes of a dictionary
SAMPLE_PIECES = 4_000      # most pieces of each kind that train a dictionary
LEVEL = 3


class Model:
    """Two dictionaries and the calibration; ships as plain bytes."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, rate: float):
        self.good, self.bad, self.weights, self.rate = good, bad, weights, rate

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False) for d in (self.good, self.bad)]

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = features(sizes)
        return np.where(sizes[:, 0] > 0, logistic(x @ self.weights[:-1] + self.weights[-1]), self.rate)


def features(sizes: np.ndarray) -> np.ndarray:
    """Of (size, size with good, size with bad): both normalised differences
    and the logarithm of the compression."""
    n, good, bad = np.maximum(1.0, sizes[:, 0]), sizes[:, 1], sizes[:, 2]
    both = good + bad + 1.0
    return np.column_stack([10 * (bad - good) / n, 10 * (bad - good) / both, np.log(both / (2 * n))])


def _dictionary(data: bytes):
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def compressed_sizes(batch, column: str, compressors) -> np.ndarray:
    """(size, size with good, size with bad) of each text, in bytes."""
    good, bad = (c.compress for c in compressors)
    out = []
    for rows, data, off in tb.text_chunks(batch, column):
        raw = memoryview(data) if len(data) else b""
        for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            g = b = 0
            for i in range(a, z, PIECE):
                part = raw[i:min(z, i + PIECE)]
                g += len(good(part))
                b += len(bad(part))
            out.append((z - a, g, b))
    return np.array(out, float).reshape(-1, 3)


def build_dictionary(parts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the pieces' own bytes where they are too few to
    train one."""
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[-size:].ljust(8, b"\n")


def text_pieces(sample: DataFrame) -> DataFrame:
    """(y, rank, piece) of all pieces of the whole texts of (doc_id, text, y);
    ``rank`` orders pieces by a hash, whatever their place."""
    def cut(batches):
        for b in batches:
            for rows, data, off in tb.text_chunks(b, "text"):
                own = [(d, n, data[i:min(z, i + PIECE)].tobytes()) for d, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                       for n, i in enumerate(range(a, z, PIECE))]
                at = pa.array([d for d, _, _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(2).take(at), pa.array([n for _, n, _ in own], pa.int64()),
                     pa.array([p for _, _, p in own], pa.binary())], names=["doc_id", "y", "n", "piece"])
    pieces = sample.select("doc_id", "text", "y").mapInArrow(cut, "doc_id long, y int, n long, piece binary")
    return pieces.select("y", F.xxhash64("doc_id", "y", "n").alias("rank"), "piece")


def train_model(docs: DataFrame, labels: DataFrame, train, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Dictionaries from one half of the sample (by a hash of doc_id), the
    calibration from the other half."""
    sample = labelled_texts(docs, labels, label, train, rows).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    sample = sample.cache()
    try:
        # a dictionary is trained in one task, from a bounded share of its kind
        def build(table: pa.Table) -> pa.Table:
            pieces = [p for _, p in sorted(zip(table.column("rank").to_pylist(), table.column("piece").to_pylist(), strict=True))]
            return pa.table({"y": table.column("y").slice(0, 1).combine_chunks().cast(pa.int32()),
                             "dictionary": pa.array([build_dictionary(pieces)], pa.binary())})

        pieces = text_pieces(sample.where("half = 0"))
        of = lambda y: pieces.where(f"y = {y}").orderBy("rank", "piece").limit(SAMPLE_PIECES)
        made = {r["y"]: bytes(r["dictionary"]) for r in of(0).unionByName(of(1)).groupBy("y").applyInArrow(build, "y int, dictionary binary").collect()}
        rate = sample.agg(F.avg("y")).first()[0]
        rate = 0.5 if rate is None else float(rate)
        if len(made) < 2:
            return Model(b"\n" * 8, b"\n" * 8, np.array([0.0, 0.0, 0.0, np.log((rate + 1e-6) / (1 - rate + 1e-6))]), rate)
        model = Model(made[1], made[0], np.zeros(4), rate)

        def measure(batches):
            c = model.compressors()
            for b in batches:
                n = compressed_sizes(b, "text", c)
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(3))], names=["y", "n", "good", "bad"])
        seen = sample.where("half = 1 AND text <> ''").select("text", "y").mapInArrow(measure, "y int, n double, good double, bad double").toPandas()
    finally:
        sample.unpersist()
    model.weights = fit_logistic(features(seen[["n", "good", "bad"]].to_numpy(float)), seen["y"].to_numpy(float))
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the three sizes of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        c = model.compressors()
        for b in batches:
            n = compressed_sizes(b, "text", c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(n)), *(pa.array(n[:, i].astype(np.int64)) for i in range(3))],
                                             names=["doc_id", "score", "n_bytes", "good_bytes", "bad_bytes"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, score double, n_bytes long, good_bytes long, bad_bytes long")


HELD_OUT = 5
THRESHOLD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its quality by the model of the training folds."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_model(docs, labels, ~is_fold(F.col("doc_id"), HELD_OUT, 0))
    return quality(docs, model).select("doc_id", is_fold(F.col("doc_id"), HELD_OUT, 0).alias("held_out"), "score",
                                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
