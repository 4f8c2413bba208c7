"""Language identification by a linear-chain conditional random field
(operator 6).

The words of a text (runs of letters) are a sequence of labels, one language
each. A word's scores are learned weights of its features: the word itself
(lexicon), its first and last one to three bytes (affixes) and its byte
trigrams, all hashed into one table. Learned transitions tie neighbours
together, so a switch of language inside a text needs evidence.
Forward-backward gives every word's posterior; a text's language is the one
with the largest mean posterior, which is its score.

Training maximises the conditional likelihood (exact forward-backward
gradients, Adam) on a bounded sample of documents whose language is given. Their
whole texts are cut into stretches of 8 to 40 words; of these, wherever in a text
they stand, a hash takes about ``TRAIN_STRETCHES`` of each language. In the
training sequences stretches of different documents, hence languages, follow
each other, so that switches are seen. The fit runs in one task.

Scoring is vectorised over whole chunks of texts. Long texts are cut into
blocks of ``BLOCK`` words whose transfer matrices are combined first, so the
result is that of the whole sequence and no step loops over single words.

``und`` with score 1 for null texts and texts without a letter; without any
training language every text is ``und`` with score 0. Ties go to the language
that sorts first. Repeated rows and null or repeated doc_ids are labelled row
by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import documents, drop_table, write_table
from .labelled import is_fold

TABLE = 1 << 17          # hashed features
TRAIN_DOCS = 300         # documents of each language in a fit (expected)
TRAIN_STRETCHES = 2_500  # stretches of their texts, of each language (expected)
STEPS = 40
BLOCK = 32
LETTERS = tb.byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
CHUNK = 2 << 20


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves


# ------------------------------------------------------------------ features
def word_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(words x 7) table rows of word and affixes; rows of the trigram at each
    byte of a word, and those bytes."""
    n = ends - starts
    cols = [tb.span_hashes(low, starts, ends)]
    for k in (1, 2, 3):
        cut = np.minimum(n, k)
        cols.append(tb.mix64(tb.span_hashes(low, starts, starts + cut) ^ np.uint64(k)))
        cols.append(tb.mix64(tb.span_hashes(low, ends - cut, ends) ^ np.uint64(16 + k)))
    rows = np.stack([(c >> np.uint64(40)).astype(np.int64) & (TABLE - 1) for c in cols], axis=1)
    word = np.zeros(len(low) + 1, np.int32)
    word[starts] += 1
    word[ends] -= 1
    inside = np.cumsum(word[:-1]) > 0
    letter = np.where(inside, low, 32).astype(np.uint32)
    before, after = np.empty_like(letter), np.empty_like(letter)
    before[:1], before[1:] = 32, letter[:-1]
    after[-1:], after[:-1] = 32, letter[1:]
    at = np.flatnonzero(inside)
    code = (before[at] << np.uint32(16)) | (letter[at] << np.uint32(8)) | after[at]
    tri = (code * np.uint32(2654435761)) >> np.uint32(32 - 17)
    return rows, tri.astype(np.int64), at


def emissions(weights, rows, tri, n_bytes):
    """Word scores: word and affix weights and the mean of its trigrams'."""
    if not len(rows):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = weights[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        out = out + weights[rows[:, i]]
    first = np.concatenate([[0], np.cumsum(n_bytes)[:-1]])
    return out + np.add.reduceat(weights[tri], first, axis=0) / n_bytes[:, None].astype(np.float32)


# ------------------------------------------------------------------ inference
def _norm(x):
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of each word's labels. ``first``: each text's first word."""
    n, k = score.shape
    if not n:
        return score
    e = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-12)
    a = _norm(np.exp(moves - moves.max())).astype(np.float32)
    words = np.diff(first)
    blocks = -(-words // BLOCK)
    start = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(start[-1])
    text = np.repeat(np.arange(len(words)), blocks)
    nth = np.arange(nb) - start[text]
    begin = first[text] + nth * BLOCK
    size = np.minimum(BLOCK, first[text + 1] - begin)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    on = np.arange(BLOCK) < size[:, None]
    eb = np.where(on[:, :, None], e[at], np.float32(1))
    # transfer matrix of each block
    m = np.broadcast_to(np.eye(k, dtype=np.float32), (nb, k, k))
    for t in range(BLOCK):
        step = (m.reshape(-1, k) @ a).reshape(nb, k, k) * eb[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        m = np.where(on[:, t, None, None], step, m)
    ahead = np.full((nb, k), 1.0 / k, np.float32)
    back = np.full((nb, k), 1.0, np.float32)
    most = int(blocks.max())
    by_len = np.argsort(-blocks, kind="stable")
    count = np.searchsorted(-blocks[by_len], -np.arange(1, most + 1), "right")  # texts with at least that many blocks
    for j in range(1, most):
        b = start[by_len[:count[j]]] + j
        ahead[b] = _norm(np.einsum("bi,bij->bj", ahead[b - 1], m[b - 1]))
    for j in range(most - 1, 0, -1):
        b = start[by_len[:count[j]]] + j
        back[b - 1] = _norm(np.einsum("bij,bj->bi", m[b], back[b]))
    alphas = np.empty((BLOCK, nb, k), np.float32)
    for t in range(BLOCK):
        ahead = np.where(on[:, t, None], _norm((ahead @ a) * eb[:, t]), ahead)
        alphas[t] = ahead
    out = np.empty((n, k), np.float32)
    for t in range(BLOCK - 1, -1, -1):
        live = on[:, t]
        out[begin[live] + t] = _norm(alphas[t][live] * back[live])
        back = np.where(live[:, None], _norm((eb[:, t] * back) @ a.T), back)
    return out


# ------------------------------------------------------------------ training
def fit(langs, rows, tri, n_bytes, y, length: int = 64, steps: int = STEPS, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Adam on the mean conditional log-likelihood of sequences of ``length``."""
    length = max(1, min(length, len(y)))
    k, n = len(langs), len(y) // length * length
    rows, n_bytes, y = rows[:n], n_bytes[:n], y[:n]
    tri = tri[:int(n_bytes.sum())]
    owner = np.repeat(np.arange(n), n_bytes)
    w, moves = np.zeros((TABLE, k), np.float32), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    truth = np.eye(k)[y].reshape(-1, length, k)
    seen = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
    for step in range(1, steps + 1):
        s = emissions(w, rows, tri, n_bytes).astype(float).reshape(-1, length, k)
        e = np.exp(s - s.max(axis=2, keepdims=True))
        a = _norm(np.exp(moves - moves.max()))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = _norm(e[:, 0])
        for t in range(1, length):
            alpha[:, t] = _norm((alpha[:, t - 1] @ a) * e[:, t])
        beta[:, -1] = 1
        expected = np.zeros((k, k))
        for t in range(length - 2, -1, -1):
            right = e[:, t + 1] * beta[:, t + 1]
            beta[:, t] = _norm(right @ a.T)
            pair = alpha[:, t][:, :, None] * a * right[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        miss = (truth - _norm(alpha * beta)).reshape(n, k)
        grad = np.empty((TABLE, k))
        mean = miss / n_bytes[:, None]
        for j in range(k):
            grad[:, j] = np.bincount(rows.ravel(), np.repeat(miss[:, j], rows.shape[1]), TABLE) + np.bincount(tri, mean[owner, j], TABLE)
        # a is row-normalised: gradient of log a through its rows
        turn = seen - expected
        turn = turn - a * turn.sum(axis=1, keepdims=True)
        for x, g, i in ((w, grad / n - ridge * w, 0), (moves, turn / n, 2)):
            state[i] += 0.1 * (g - state[i])
            state[i + 1] += 0.001 * (g * g - state[i + 1])
            x += (rate * (state[i] / (1 - 0.9 ** step)) / (np.sqrt(state[i + 1] / (1 - 0.999 ** step)) + 1e-8)).astype(x.dtype)
    return Model(langs, w, moves)


def stretches(sample: DataFrame) -> DataFrame:
    """(lang, place, text) of all stretches of 8 to 40 words of the whole texts
    of (lang, place, text); ``place`` then orders the stretches by a hash."""
    def cut(batches):
        for b in batches:
            for rows, data, off in tb.text_chunks(b, "text"):
                starts, ends, first = tb.word_spans(tb.LOWER[data], off, LETTERS)
                own, nth, text = [], [], []
                for d in range(len(rows)):
                    rng = np.random.default_rng(int(off[d + 1] - off[d]))
                    i, n = int(first[d]), 0
                    while i < first[d + 1]:
                        j = min(int(first[d + 1]), i + int(rng.integers(8, 41)))
                        own.append(d)
                        nth.append(n)
                        text.append(data[starts[i]:ends[j - 1]].tobytes().decode("utf-8", "replace"))
                        i, n = j, n + 1
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(nth, pa.int64()), pa.array(text, pa.string())],
                                                 names=["lang", "place", "nth", "text"])
    table = sample.select("lang", "place", "text").mapInArrow(cut, "lang string, place long, nth long, text string")
    return table.select("lang", F.pmod(F.xxhash64("place", "nth", "text"), F.lit(1_000_000)).alias("place"), "text")


def train_model(docs: DataFrame, train, per_lang: int = TRAIN_DOCS, per_lang_stretches: int = TRAIN_STRETCHES) -> Model:
    """Fit on about ``per_lang_stretches`` stretches of the texts of about
    ``per_lang`` documents of each language, both chosen by hashes, among the
    documents with ``train`` true."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1_000_000))
    share = lambda most, counts: F.create_map(*(F.lit(x) for lang in langs for x in (
        lang, int(min(1_000_000, 1_000_000 * most / max(1, counts.get(lang, 0))) + 1))))[F.col("lang")]
    found = write_table(stretches(known.where(place < share(per_lang, counts)).select("lang", place.alias("place"), "text")), "stretches")
    counts = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = found.where(F.col("place") < share(per_lang_stretches, counts)).withColumn("fit", F.lit(1))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("text", "ascending")]).combine_chunks()
        batch = table.to_batches()[0]
        y = np.array([langs.index(x) for x in table.column("lang").to_pylist()])
        words, labels = [], []
        rng = np.random.default_rng(7)
        for rows, data, off in tb.text_chunks(batch, "text", 1 << 30):
            low = tb.LOWER[data]
            starts, ends, first = tb.word_spans(low, off, LETTERS)
            # in random order: languages alternate
            pieces = [(int(first[d]), int(first[d + 1]), y[d]) for d in range(len(rows))]
            order = rng.permutation(len(pieces))
            words = np.concatenate([np.arange(pieces[o][0], pieces[o][1]) for o in order]) if pieces else np.zeros(0, np.int64)
            labels = np.concatenate([np.full(pieces[o][1] - pieces[o][0], pieces[o][2]) for o in order]) if pieces else np.zeros(0, np.int64)
            f, tri, _ = word_features(low, starts, ends)
        size = ends - starts
        begin = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(begin[words] - np.concatenate([[0], np.cumsum(size[words])[:-1]]), size[words]) + np.arange(int(size[words].sum()))
        model = fit(langs, f[words], tri[pick], size[words], labels)
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "moves": pa.array([model.moves.tobytes()], pa.binary())})

    got = sample.groupBy("fit").applyInArrow(run, "weights binary, moves binary").first()
    drop_table(found)
    k = len(langs)
    if got is None:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)))
    return Model(langs, np.frombuffer(got["weights"], np.float32).reshape(TABLE, k), np.frombuffer(got["moves"], float).reshape(k, k))


# ------------------------------------------------------------------ scoring
def identify(docs: DataFrame, model: Model, runs: bool = True) -> DataFrame:
    """Per row: doc_id, lang_pred, score and, if asked for, ``runs``: the
    stretches of words of one language (first, last, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def scan(batches):
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        k = len(model.langs)
        for b in batches:
            for rows, data, off in tb.text_chunks(b, "text", CHUNK):
                low = tb.LOWER[data]
                starts, ends, first = tb.word_spans(low, off, LETTERS)
                letters = np.asarray(rows.column(2))
                n = np.diff(first)
                best, score, parts = np.full(len(rows), k), np.where(letters, 0.0, 1.0), [[] for _ in range(len(rows))]
                if k and len(starts):
                    f, tri, _ = word_features(low, starts, ends)
                    post = posteriors(emissions(model.weights, f, tri, ends - starts), first, model.moves)
                    run = np.concatenate([np.zeros((1, k)), np.cumsum(post, axis=0, dtype=float)])
                    mean = (run[first[1:]] - run[first[:-1]]) / np.maximum(n, 1)[:, None]
                    has = letters & (n > 0)
                    best = np.where(has, mean.argmax(axis=1), k)
                    score = np.where(has, np.clip(mean.max(axis=1), 0, 1), score)
                    if runs:
                        label = post.argmax(axis=1)
                        new = np.append(True, label[1:] != label[:-1])
                        new[first[:-1][n > 0]] = True
                        cut = np.flatnonzero(new)
                        end = np.append(cut[1:], len(label)) - 1
                        own = np.searchsorted(first, cut, "right") - 1
                        for c, z, d in zip(cut.tolist(), end.tolist(), own.tolist(), strict=True):
                            parts[d].append({"first": int(c - first[d]), "last": int(z - first[d]), "lang": model.langs[label[c]]})
                cols = [rows.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(parts, kind)] if runs else cols,
                                                 names=["doc_id", "lang_pred", "score", *(["runs"] if runs else [])])
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(
        scan, "doc_id long, lang_pred string, score double" + (", runs array<struct<first: int, last: int, lang: string>>" if runs else ""))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its language by the model of the training folds."""
    docs = documents(spark, sf_dir)
    found = identify(docs, train_model(docs, ~is_fold(F.col("doc_id"), 3, 1)), runs=False)
    return found.select("doc_id", is_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
