"""Substring dedup by sliding sentence spans (operator 2).

Words are runs of non-space characters. A sentence ends with a word whose last
character, apart from closing quotes, brackets and emphasis marks, is a full
stop, question or exclamation mark or ellipsis of any script of ``STOP_MARKS``,
at a line end, or with the text. A span is a run of at least ``sentences``
sentences, however short, or of at least ``words`` words, be it a single
sentence; every shortest such run from each sentence on, and up to each
sentence, is hashed (128 bits over its words). Any stretch of that size or more
that two places share is therefore covered by shared spans, whatever surrounds
it. Spans meet globally by hash. The first occurrence, by doc_id and then place,
stays; sentences that any other occurrence covers are removed, within a text
too. Only whole sentences go: the words of a repeated run before its first and
after its last sentence boundary stay.

Copies of a span are counted before they are shuffled; a text's removed
sentences are joined back to it without moving other texts when their size
permits.

Null and empty texts have no sentences and come back empty. Null doc_ids come
first; rows with the same doc_id and text are one document and come back
alike. An empty table gives no rows; other columns are ignored. Texts of fewer
sentences and words than a span are never changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import BROADCAST_BYTES, documents, write_table

SENTENCES = 2
WORDS = 20

#: Marks that end a sentence (Latin, CJK, Arabic, Devanagari, Armenian, Ethiopic,
#: Khmer, Burmese) and marks that may follow them.
STOP_MARKS = ".!?\u2026\u203c\u203d\u2047\u2048\u2049\u3002\uff0e\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u17d4\u104b"
CLOSING_MARKS = "\"'`)]}>*_\u00bb\u00ab\u2018\u2019\u201c\u201d\u201e\u2039\u203a\u300d\u300f\u3009\u300b\u3011\u3015\uff09\uff3d\uff5d"


def _byte_codes(marks: str) -> dict[int, np.ndarray]:
    """UTF-8 bytes of the marks as numbers, by their count."""
    raw = [c.encode() for c in marks]
    return {n: np.array([int.from_bytes(r, "big") for r in raw if len(r) == n]) for n in (1, 2, 3)}


_STOPS, _CLOSERS = _byte_codes(STOP_MARKS), _byte_codes(CLOSING_MARKS)


def last_mark(data, starts, ends, codes) -> np.ndarray:
    """Bytes of the mark of ``codes`` that each byte range ends with, or 0."""
    found, code = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    for n in (1, 2, 3):
        at = ends - n
        code += data[np.maximum(at, 0)].astype(np.int64) << (8 * (n - 1))
        found[(at >= starts) & np.isin(code, codes[n])] = n
    return found


def ends_sentence(data, starts, ends) -> np.ndarray:
    """Whether each word ends with a stop, closing marks after it apart."""
    stop = last_mark(data, starts, ends, _STOPS) > 0
    left, e = np.flatnonzero(~stop), ends[~stop]
    while len(left):
        n = last_mark(data, starts[left], e, _CLOSERS)
        left, e = left[n > 0], (e - n)[n > 0]
        now = last_mark(data, starts[left], e, _STOPS) > 0
        stop[left[now]] = True
        left, e = left[~now], e[~now]
    return stop


def sentence_starts(data, starts, ends, first):
    """First word of each sentence of a chunk, closed by the word count, and
    the first sentence of each text (length: texts + 1)."""
    n = len(starts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(first), np.int64)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    stop = ends_sentence(data, starts, ends)
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[first[1:][first[1:] > 0] - 1] = True
    begin = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return begin, np.searchsorted(begin, first)


def spans(begin: np.ndarray, text: np.ndarray, sentences: int, words: int):
    """(first, last) sentence of every span; ``text`` as of sentence_starts."""
    n = len(begin) - 1
    i = np.arange(n)
    own = np.searchsorted(text, i, "right") - 1
    lo, hi = text[own], text[own + 1] - 1
    # the shortest run by either floor
    end = np.minimum(i + sentences - 1, np.searchsorted(begin, begin[:-1] + words) - 1)
    start = np.maximum(i - sentences + 1, np.searchsorted(begin, begin[1:] - words, "right") - 1)
    ahead, back = end <= hi, start >= lo
    both = np.concatenate([i[ahead] * n + end[ahead], start[back] * n + i[back]])
    both = np.unique(both)
    return both // max(n, 1), both % max(n, 1)


def text_sentences(batch, column="text"):
    for rows, data, off in tb.text_chunks(batch, column):
        starts, ends, first = tb.word_spans(data, off, tb.NON_SPACE)
        yield rows, data, off, starts, ends, sentence_starts(data, starts, ends, first)


def span_table(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    def scan(batches):
        for b in batches:
            for rows, data, _, starts, ends, (begin, text) in text_sentences(b):
                if len(begin) < 2:
                    continue
                x, y = spans(begin, text, sentences, words)
                a, z = begin[x], begin[y + 1]
                own = np.searchsorted(text, x, "right") - 1
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(tb.span_hashes(tb.span_hashes(data, starts, ends, seed), a, z, seed).view(np.int64)) for seed in (0, 1)),
                     rows.column(0).take(at), rows.column(1).take(at),
                     pa.array((x - text[own]).astype(np.int32)), pa.array((y - text[own]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "version", "first", "last"])
    return keyed(docs).mapInArrow(scan, "h1 long, h2 long, doc_id long, version long, first int, last int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def repeated_sentences(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, version, gone): the sentences to remove of each text."""
    found = span_table(docs, sentences, words)
    place = F.struct("doc_id", "version", "first")
    known = found.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.max(place).alias("most")).where("keep <> most")
    known = write_table(known.select("h1", "h2", "keep"), "repeated-spans")
    again = found.join(known, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keep")))
    ranges = again.select("doc_id", "version", "first", "last").distinct()
    return (ranges.select("doc_id", "version", F.explode(F.sequence("first", "last")).alias("s"))
            .groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("s")).alias("gone")))


def sentence_dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_sentences, n_removed, and the text that is left."""
    gone = write_table(repeated_sentences(docs, sentences, words), "repeated-sentences")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "gone")
    size = gone.agg(F.sum(F.size("gone") * 4 + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    rows = keyed(docs)
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["version"] == gone["_version"]), "left")

    def cut(batches):
        for b in batches:
            for part, data, off, starts, _, (begin, text) in text_sentences(b):
                out, total, less = [], [], []
                for i, drop in enumerate(part.column(2).to_pylist()):
                    n = int(text[i + 1] - text[i])
                    total.append(n)
                    less.append(len(drop or ()))
                    raw = data[off[i]:off[i + 1]]
                    if drop:
                        # a sentence reaches to the next one's first word
                        at = np.append(starts[begin[text[i]:text[i + 1]]], off[i + 1]) - off[i]
                        keep = np.ones(n, bool)
                        keep[drop] = False
                        raw = np.concatenate([raw[:at[0]], *(raw[at[s]:at[s + 1]] for s in np.flatnonzero(keep))])
                    out.append(raw.tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(less, pa.int64()), pa.array(out, pa.string())],
                                                 names=["doc_id", "n_sentences", "n_removed", "text"])
    return rows.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, text string")


def op2_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its sentences, those removed, and the text that is left."""
    return sentence_dedup(documents(spark, sf_dir))
