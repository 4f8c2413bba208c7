"""Fits and scores over whole texts, against plain versions in Python."""

import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("vigil.llm")
from vigil.llm import compression, decontaminate, langid, toxicity  # noqa: E402
from vigil.llm.labelled import logistic  # noqa: E402

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_windows(docs, bench, span=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(0, len(w) - min(len(w), span)) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + span]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    items |= found
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), tuple(sorted(items))))
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 0])
def test_decontaminate_matches_brute_force(spark, monkeypatch, limit):
    """Long, repetitive and very short items; both ways of the join."""
    rng = np.random.default_rng(5)
    text = lambda n, v: " ".join(f"w{i}" for i in rng.integers(0, v, n))
    bench = [(1, text(2_000, 500)), (2, "a " * 300), (3, "a b " * 40), (4, text(9, 4)), (5, "Z9"), (6, text(10, 3)), (7, None), (8, " - "), (9, text(60, 2)), (2, "a " * 300)]
    long = bench[0][1].split()
    docs = [(1, "x " + " ".join(long[700:709]) + " y"), (2, " ".join(long[700:711])), (3, "B A " * 30), (4, "a " * 25), (5, text(400, 2)), (6, text(50, 3)),
            (7, " ".join(long[:10]) + " z9 " + " ".join(long[-10:])), (8, None), (9, ""), (10, "a " * 9)]
    if limit is not None:
        small = decontaminate.broadcast_if_small
        monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, size: small(df, size, limit))
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()) == brute_windows(docs, bench)


def test_fingerprints_carry_only_a_window(spark):
    """The benchmark side grows with the items' words, not with their square;
    an endlessly repeated word has a handful of fingerprints."""
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4_000))), (2, "a " * 4_000)], "item_id long, text string")
    items = decontaminate.item_table(bench)
    prints = items.select("item_id", F.explode("prints").alias("p"))
    assert prints.agg(F.max(F.size("p.words"))).first()[0] <= 2 * decontaminate.SPAN - decontaminate.GRAM
    assert prints.where("item_id = 2").count() <= 2 * decontaminate.SPAN
    rows = prints.select("item_id", F.col("p.words").alias("item_words"))
    counted = rows.agg(F.sum(decontaminate.print_bytes())).first()[0]
    assert 4_000 * 20 < counted < 4_000 * 1_000


def brute_segments(s, lo, hi):
    """The best segment (the shortest, then the first), then both sides."""
    total = np.concatenate([[0.0], np.cumsum(s)])
    best = max(((round(total[j] - total[i], 6), i - j, -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return brute_segments(s, lo, i) + [(i, j - 1, best[0])] + brute_segments(s, j, hi)


def test_all_maximal_segments_match_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(200):
        s = rng.normal(-0.2, 1, 25)
        found = toxicity.maximal_segments(np.concatenate([[0.0], np.cumsum(s)]), np.flatnonzero(s > 0))
        assert [(a, z, pytest.approx(v, abs=1e-5)) for a, z, v in found] == brute_segments(s, 0, 25)


def test_toxic_passages_match_brute_force(spark):
    """Every word with a score counts, and passages are found anywhere; in a
    longer text a passage must score more, as its p-value counts all words."""
    rng = np.random.default_rng(3)
    bad = [f"b{i}" for i in range(8)]  # each often enough for a score above the drift
    fine = [f"f{i}" for i in range(400)]
    rows = []
    for i in range(400):
        w = list(rng.choice(fine, 120))
        if i % 2:
            w[80:80] = list(rng.choice(bad, 40))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (900, " ".join(["f1"] * 40_000 + bad * 25)), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train_model(docs, labels, F.col("doc_id") % 5 != 0)
    held = {r.doc_id: r for r in toxicity.toxic_passages(docs, model).collect()}
    score = {w: float(model.word_scores(toxicity.tb.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])))[0]) for w in bad + fine}
    for i, text in rows[:60:5]:
        s = np.array([score[w] for w in text.split()])
        segments = [(a, z, v) for a, z, v in brute_segments(s, 0, len(s))]
        sure = [(a, z) for a, z, v in segments if model.minus_ln_p(v, len(s)) >= -math.log(toxicity.P_MAX)]
        assert [(p["first"], p["last"]) for p in held[i]["passages"]] == sure and bool(sure) == bool(i % 2)
        want = logistic(np.array(model.features(segments, len(s))) @ model.weights[:-1] + model.weights[-1])
        assert held[i]["score"] == pytest.approx(float(want), abs=1e-6) and (held[i]["score"] >= 0.5) == bool(i % 2)
    assert held[900]["score"] >= 0.5 and held[900]["passages"][-1]["last"] == 40_199 and held[901]["score"] < 0.5


def test_quality_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in ("good", "fine", "neat", "calm") for b in range(50)], [f"{a}{b}" for a in ("spam", "junk", "click", "buy") for b in range(50)]
    # what tells the kinds apart stands behind 9,000 characters that do not
    front = " ".join(f"same{i}" for i in range(1_200))
    rows = [(i, front + " " + " ".join(rng.choice(vocab[1 - i % 2], 300))) for i in range(160)] + [(900, None), (901, ""), (902, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    model = compression.train_model(docs, labels, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in compression.quality(docs, model).collect()}
    dicts = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]
    packed = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=d, write_content_size=False) for d in dicts]
    for i, text in rows:
        raw = (text or "").encode()
        sizes = [sum(len(c.compress(raw[a:a + compression.PIECE])) for a in range(0, len(raw), compression.PIECE)) for c in packed]
        assert (found[i]["n_bytes"], found[i]["good_bytes"], found[i]["bad_bytes"]) == (len(raw), *sizes)
        if not raw:
            assert found[i]["score"] == pytest.approx(model.rate)
            continue
        x = np.array([10 * (sizes[1] - sizes[0]) / len(raw), 10 * (sizes[1] - sizes[0]) / (sum(sizes) + 1.0), math.log((sum(sizes) + 1.0) / (2 * len(raw)))])
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-(x @ model.weights[:-1] + model.weights[-1]))))
    held = [i for i in range(0, 160, 5)]
    assert np.mean([(found[i]["score"] >= 0.5) == bool(i % 2) for i in held]) > 0.95


def test_pieces_cover_whole_texts(spark):
    text = "".join(chr(0x61 + i % 26) + "é" for i in range(5_000))
    sample = spark.createDataFrame([(1, text, 1), (2, "", 0), (3, "short", 0)], "doc_id long, text string, y int")
    got = compression.text_pieces(sample).collect()
    assert sum(len(r.piece) for r in got if r.y == 1) == len(text.encode()) and [bytes(r.piece) for r in got if r.y == 0] == [b"short"]


def test_stretches_cover_whole_texts(spark):
    text = " ".join("abcdefghij"[i % 10] * (1 + i % 5) for i in range(5_000))
    sample = spark.createDataFrame([("x", 1, text), ("y", 2, "12 -- 3"), ("z", 3, "Ünï one")], "lang string, place long, text string")
    got = langid.stretches(sample).collect()
    count = lambda lang: sorted(w for r in got if r.lang == lang for w in r.text.split())
    assert count("x") == sorted(text.split()) and count("y") == [] and count("z") == ["one", "Ünï"]
    assert max(len(r.text.split()) for r in got) <= 40


def test_languages_that_differ_behind_long_starts(spark):
    """A fit over prefixes would see the same words in both languages."""
    rng = np.random.default_rng(8)
    front = " ".join(["same", "words", "here"] * 120)
    rows = [(i, ("p", "q")[i % 2], front + " " + " ".join(rng.choice([f"{'xy'[i % 2]}{c}{d}" for c in "abcde" for d in "fghij"], 600))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train_model(table, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.lang_pred for r in langid.identify(table, model, runs=False).collect()}
    assert all(got[i] == lang for i, lang, _ in rows)


def test_few_words_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "p", "word"), (2, "q", "1 2"), (3, None, None)], "doc_id long, lang string, text string")
    model = langid.train_model(one, F.lit(True))
    assert langid.identify(one, model).count() == 3 and langid.identify(one.limit(0), model).count() == 0
    none = langid.train_model(one.where("doc_id = 2"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(one, none).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = one.select("doc_id", "text")
    assert toxicity.toxic_passages(docs.limit(0), toxicity.train_model(docs.limit(0), labels, F.lit(True))).count() == 0
    assert compression.quality(docs.limit(0), compression.train_model(docs.limit(0), labels, F.lit(True))).count() == 0
