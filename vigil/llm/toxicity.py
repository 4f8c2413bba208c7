"""Toxic passages as maximum-scoring segments (operator 1).

Training, on a bounded sample of labelled documents:
1. Word counts in toxic and in clean documents give log-odds with an
   informative Dirichlet prior (the words' shares in both, ``PRIOR`` words
   strong). A word's score is its log-odds moved toward 0 by ``Z`` standard
   deviations, so words without evidence score 0; every word pays ``DRIFT``.
2. Karlin-Altschul statistics on the clean documents: lambda solves
   E[exp(lambda * score)] = 1, K comes from the Gumbel distribution of the
   documents' best segments.
3. Scores of documents become probabilities by a logistic fit over the best
   segment's -ln p, that of the other significant segments, and their number.

Scoring reads each whole text once: the Ruzzo-Tompa scan finds all maximal
scoring segments in linear time; those with p <= ``P_MAX`` are passages.

Null and empty texts have no passage and get the score of a text without any.
Without labels of both classes every document gets the base rate. Repeated
rows and null or repeated doc_ids are scored row by row; an empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents
from .labelled import TRAIN_ROWS, fit_logistic, is_fold, labelled_texts, logistic

PRIOR = 50_000.0     # words that the prior is worth
Z = 1.96             # standard deviations by which log-odds are moved toward 0
DRIFT = 0.25         # what every word costs
P_MAX = 0.05         # passages are segments at least this significant
CAP = 60.0           # largest -ln p

PASSAGE = "struct<first: int, last: int, score: double, p: double, text: string>"


class Model:
    """Sorted word hashes with their scores, and the calibration."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, drift: float = DRIFT):
        self.keys, self.scores, self.drift = keys, scores, drift
        self.rate, self.k = 1.0, 1.0
        self.weights = np.zeros(4)

    def word_scores(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -self.drift)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.scores[at], 0.0) - self.drift

    def minus_ln_p(self, score: float, words: int) -> float:
        """-ln P(best segment of that many words >= score)."""
        e = math.exp(min(50.0, math.log(self.k * max(words, 1)) - self.rate * score))
        p = -math.expm1(-e)
        return min(CAP, -math.log(p) if p > 0 else self.rate * score - math.log(self.k * max(words, 1)))

    def features(self, segments, words: int) -> list[float]:
        found = sorted((self.minus_ln_p(s, words) for _, _, s in segments), reverse=True)
        sure = [x for x in found if x >= -math.log(P_MAX)]
        return [found[0] if found else 0.0, min(CAP, sum(sure[1:])), math.log1p(len(sure))]


def maximal_segments(total: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) by Ruzzo and Tompa.
    ``total``: running sums (one more than words); ``at``: the words with a
    positive score, the only ones at which a segment can begin or end."""
    first, last, low, high, link = [], [], [], [], []
    for i in at.tolist():
        a, lo, hi = i, total[i], total[i + 1]
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            # the candidates from j on become one
            a, lo = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j -= 1
        first.append(a)
        last.append(i)
        low.append(lo)
        high.append(hi)
        link.append(j)
    return [(a, z, float(h - lo)) for a, z, lo, h in zip(first, last, low, high, strict=True)]


def chunk_segments(model: Model, rows, low, starts, ends, first, h):
    """Per text: its segments (word indices from the text's first word)."""
    s = model.word_scores(h)
    up = np.flatnonzero(s > 0)
    cut = np.searchsorted(up, first)
    out = []
    for i in range(len(rows)):
        a, z = cut[i], cut[i + 1]
        if a == z:
            out.append([])
            continue
        b, e = first[i], first[i + 1]
        # summed from the text's own start: the same in any chunk
        out.append(maximal_segments(np.concatenate([[0.0], np.cumsum(s[b:e])]), up[a:z] - b))
    return out


def chunks(batch, column="text"):
    for rows, data, off in tb.text_chunks(batch, column):
        low = tb.LOWER[data]
        starts, ends, first = tb.word_spans(low, off, tb.ALNUM)
        yield rows, data, starts, ends, first, tb.span_hashes(low, starts, ends)


# ------------------------------------------------------------------ training
def word_counts(train: DataFrame) -> DataFrame:
    """(word, toxic, clean) counts of the sample, added up by Spark."""
    def scan(batches):
        for b in batches:
            for rows, _, _, _, first, h in chunks(b):
                y = np.repeat(np.asarray(rows.column(1)), np.diff(first))
                u, inv = np.unique(h, return_inverse=True)
                t = np.bincount(inv, weights=y, minlength=len(u)).astype(np.int64)
                n = np.bincount(inv, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n - t)], names=["word", "toxic", "clean"])
    return (train.select("text", "y").mapInArrow(scan, "word long, toxic long, clean long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def log_odds(counts: DataFrame) -> DataFrame:
    """(word, score, clean) of all words whose log-odds differ from 0. They are
    bounded by the sample: a score needs evidence, so a word of ``n`` of the
    sample's ``N`` words has one only if (Z / ln(1 + N / PRIOR))^2 <= n * PRIOR / N
    (about one scored word to 70 words of text at 40 million words)."""
    n = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = float(n["t"] or 0), float(n["c"] or 0)
    if not t or not c:
        return counts.select("word", F.lit(0.0).alias("score"), "clean").limit(0)
    a = (F.col("toxic") + F.col("clean")) * F.lit(PRIOR / (t + c))
    toxic, clean = F.col("toxic") + a, F.col("clean") + a
    delta = F.log(toxic / (t + PRIOR - toxic)) - F.log(clean / (c + PRIOR - clean))
    deviation = F.sqrt(1 / toxic + 1 / clean)
    score = F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - Z * deviation)
    return counts.select("word", score.alias("score"), "clean").where("score <> 0")


def train_model(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents with ``train`` true."""
    sample = labelled_texts(docs, labels, label, train, rows).cache()
    try:
        counts = word_counts(sample).cache()
        words = log_odds(counts).toPandas().sort_values("word")
        keys = words["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        model = Model(keys[order], words["score"].to_numpy(float)[order])
        clean = float(counts.agg(F.sum("clean")).first()[0] or 0)
        counts.unpersist()
        share = words["clean"].to_numpy(float) / max(clean, 1.0)
        step = words["score"].to_numpy(float) - model.drift
        model.rate = karlin_rate(np.append(step, -model.drift), np.append(share, max(0.0, 1 - share.sum())))

        def best(batches):
            for b in batches:
                for part in chunks(b):
                    found = chunk_segments(model, *part)
                    yield pa.RecordBatch.from_arrays(
                        [part[0].column(1), pa.array(np.diff(part[4])), pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.float64()))],
                        names=["y", "words", "scores"])
        seen = sample.select("text", "y").mapInArrow(best, "y int, words long, scores array<double>").toPandas()
    finally:
        sample.unpersist()
    y, n = seen["y"].to_numpy(float), seen["words"].to_numpy(float)
    top = np.array([max(s, default=0.0) for s in seen["scores"]])
    ok = (y == 0) & (n > 0)
    if ok.any():
        # Gumbel with scale 1: maximum likelihood of its place, ln K
        model.k = 1 / np.mean(np.exp(np.clip(-(model.rate * top[ok] - np.log(n[ok])), -50, 50)))
    x = np.array([model.features([(0, 0, s) for s in f], int(w)) for f, w in zip(seen["scores"], n, strict=True)]).reshape(-1, 3)
    model.weights = fit_logistic(x, y)
    return model


def karlin_rate(step: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * step)) = 1."""
    f = lambda r: float(share @ np.exp(np.clip(r * step, -700, 700))) - 1
    if step.max() <= 0 or share @ step >= 0 or not share[step > 0].any():
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(hi, 20.0)


# ------------------------------------------------------------------ scoring
def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, n_words and the significant passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p", pa.float64()), ("text", pa.string())]))

    def scan(batches):
        model = shared.value
        for b in batches:
            for part in chunks(b):
                rows, data, starts, ends, first, _ = part
                x, passages = [], []
                for i, found in enumerate(chunk_segments(model, *part)):
                    n = int(first[i + 1] - first[i])
                    x.append(model.features(found, n))
                    passages.append([
                        {"first": a, "last": z, "score": s, "p": math.exp(-q),
                         "text": data[starts[first[i] + a]:ends[first[i] + z]].tobytes().decode("utf-8", "replace")}
                        for a, z, s in found if (q := model.minus_ln_p(s, n)) >= -math.log(P_MAX)])
                score = logistic(np.asarray(x) @ model.weights[:-1] + model.weights[-1])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(np.diff(first)), pa.array(passages, kind)],
                                                 names=["doc_id", "score", "n_words", "passages"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, f"doc_id long, score double, n_words long, passages array<{PASSAGE}>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        for b in batches:
            for part in chunks(b):
                x = [model.features(f, int(n)) for f, n in zip(chunk_segments(model, *part), np.diff(part[4]), strict=True)]
                yield part[0].filter(pa.array(logistic(np.asarray(x) @ model.weights[:-1] + model.weights[-1]) < threshold))
    return docs.mapInArrow(scan, docs.schema)


HELD_OUT = 5


def model_for(docs: DataFrame, sf_dir: str) -> Model:
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return train_model(docs, labels, ~is_fold(F.col("doc_id"), HELD_OUT, 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its toxicity by the model of the training folds."""
    docs = documents(spark, sf_dir)
    found = toxic_passages(docs, model_for(docs, sf_dir))
    return found.select("doc_id", is_fold(F.col("doc_id"), HELD_OUT, 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic."""
    return keep_clean(docs, model_for(docs, sf_dir))
