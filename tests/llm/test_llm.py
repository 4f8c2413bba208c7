"""The text operators on small fixtures: edge rows, brute force, round trips."""

import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vigil.llm")

from vigil.llm import (compression, decontaminate, exact_dedup, langid, ngram_join, packing, quotes,  # noqa: E402
                       revisits, sentence_dedup, toxicity)

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
WORDS = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (5, "  \n"), (6, LONG), (None, WORDS + " more"), (7, "Ünï \U0001F600 x"), (8, "123 --")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns
    named like those of the operators."""
    d = spark.createDataFrame([(i, t, "en", 1.0, 2, 3) for i, t in ROWS],
                              "doc_id long, text string, lang string, score double, node int, size int")
    return d.withColumn("digest", F.lit("x")).withColumn("row", F.lit(0))


def by_id(rows):
    return sorted(([tuple(r) for r in rows]), key=str)


def test_exact_dedup_edges(docs):
    rows = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert len(rows) == len(ROWS)
    group = [r for r in rows if r.doc_id in (1, 2)]
    assert {(r.keep_id, r.group_size) for r in group} == {(2, 3)} and sum(r.kept for r in group) == 1
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows if r.doc_id in (3, 4)} == {(3, 4, False), (4, 4, True)}


def test_exact_dedup_compares_full_bytes(docs):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 2, "0"))
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    assert by_id(exact_dedup.exact_dedup(docs, weak).select(*cols).collect()) == by_id(exact_dedup.exact_dedup(docs).select(*cols).collect())


def test_exact_dedup_state_continues(spark, docs, tmp_path):
    exact_dedup.digest_rows(docs.where("doc_id = 1")).write.parquet(f"{tmp_path}/rows")
    exact_dedup.update_state(spark, f"{tmp_path}/rows", f"{tmp_path}/state")
    exact_dedup.digest_rows(docs.where("doc_id = 2")).write.mode("append").parquet(f"{tmp_path}/rows")
    state = exact_dedup.update_state(spark, f"{tmp_path}/rows", f"{tmp_path}/state").collect()
    assert [(r.n, r.keep_id) for r in state] == [(3, 2)]


def test_decontaminate_edges(spark, docs):
    bench = spark.createDataFrame([(1, "zero " + WORDS), (2, "Ünï"), (3, "nine ten"), (4, None), (5, "w5 w6 w7 w8 w9")], "item_id long, text string")
    rows = decontaminate.decontaminate(docs, bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == (12, 12, ["1", "3"]) and got[None] == (13, 12, ["1", "3"])
    assert got[7] == (2, 1, ["2"]) if got[7][0] == 2 else got[7][1] == 1
    assert got[6] == (30_000, 5, ["5"]) and got[3] == (0, 0, [])


def test_winnowing_keeps_one_gram_in_every_window():
    grams = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    keep = decontaminate.winnow(grams, 6)
    assert all(keep[i:i + 6].any() for i in range(495)) and keep.mean() < 0.7


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[p:p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    ids = {}
    for (i, _), r in zip(rows, root):
        ids[r] = min(x for x in (ids.get(r), i) if x is not None) if (ids.get(r), i) != (None, None) else None
    return sorted(((i, len(s), ids[r] if s else i) for (i, _), s, r in zip(rows, sets, root)), key=str)


def test_ngram_components_match_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    rows, base = [(i, t) for i, t in ROWS if i != 6], [f"t{i}" for i in rng.integers(0, 400, 90)]
    for i in range(60):  # near copies with a few edits each
        words = list(base)
        for p in rng.integers(0, 90, int(rng.integers(0, 6))):
            words[p] = f"e{i}{p}"
        rows.append((100 + i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(d).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_ngram_turns_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in rng.integers(0, 300, 80)]
    rows = []
    for i in range(70):  # a family whose members are near the threshold
        words = list(base)
        for p in rng.integers(0, 80, int(rng.integers(0, 7))):
            words[p] = f"e{i}{p}"
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    turns, plain = [], ngram_join._crowded
    monkeypatch.setattr(ngram_join, "CROWDED", 0)
    monkeypatch.setattr(ngram_join, "_crowded", lambda r, f: turns.append(plain(r, f)) or turns[-1])
    got = ngram_join.ngram_components(d).collect()
    assert any(turns)
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        apart = ngram_join.hamming(*(np.frombuffer(ngram_join.signature(s), np.uint8) for s in (x, y)))
        short = np.bitwise_count((ngram_join.folded(ngram_join.signature(x)) ^ ngram_join.folded(ngram_join.signature(y))).view(np.uint64)).sum()
        assert short <= apart <= len(np.setxor1d(x, y))


def test_sentence_dedup(spark, docs):
    passage = " ".join(f"p{i}" for i in range(14)) + ". " + " ".join(f"q{i}" for i in range(14)) + ". "
    d = spark.createDataFrame([(1, "First a b. " + passage + "End c."), (2, passage + "Other tail."), (3, None), (4, "Short. Short.")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in sentence_dedup.sentence_dedup(d).collect()}
    assert got[1] == (4, 0, "First a b. " + passage + "End c.")
    assert got[2] == (3, 2, "Other tail.") and got[3] == (0, 0, "") and got[4] == (2, 0, "Short. Short.")
    assert sentence_dedup.sentence_dedup(docs).count() == len(ROWS)


def brute_sentences(text):
    """Sentences as lists of words, by a loop over words and lines."""
    out, now = [], []
    for line in text.split("\n"):
        for w in line.split():
            now.append(w)
            if w.rstrip("".join(sentence_dedup.CLOSING_MARKS))[-1:] in tuple(sentence_dedup.STOP_MARKS):
                out, now = out + [now], []
        if now:
            out, now = out + [now], []
    return out


def brute_removed(rows):
    """Sentences that lie in a run of at least 2 sentences or 20 words that stands at an earlier place too."""
    seen, gone = set(), {}
    for i, t in rows:
        s = brute_sentences(t)
        gone[i] = set()
        for a in range(len(s)):
            for z in range(a, len(s)):
                words = tuple(w for x in s[a:z + 1] for w in x)
                if z > a or len(words) >= 20:
                    if words in seen:
                        gone[i] |= set(range(a, z + 1))
                    seen.add(words)
    return gone


def test_sentence_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    ends = [".", "!", "?", '."', ".)", "\u3002", "?\u201d", "\u2026'", "\n"]
    source = [words(int(n)) for n in rng.choice([2, 4, 30, 45, 70], 60)]
    source = [w for x in source for w in [*x[:-1], x[-1] + ends[int(rng.integers(0, len(ends)))]]]
    rows, runs = [], []
    for i in range(60):  # runs of 50 words and more from anywhere in the source, between words of their own
        a, n = int(rng.integers(0, len(source) - 80)), int(rng.integers(50, 80))
        rows.append((i, " ".join([*words(3), *source[a:a + n], *words(3)])))
        runs.append((a, a + n))
    rows += [(100, "Alone x. " + " ".join(["l"] * 5 + words(25)) + ". Tail a."), (102, "One (two). Three."), (103, "Zero. One (two). Three.")]
    rows.append((101, "Other y. " + rows[60][1].split(". ")[1] + ". Tail b."))
    rows.sort()
    expected = brute_removed(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.gone) for r in sentence_dedup.repeated_sentences(d).collect()}
    assert got == {i: g for i, g in expected.items() if g}
    assert got[101] == {1} and got[103] == {1, 2}
    totals = {r.doc_id: r.n_sentences for r in sentence_dedup.sentence_dedup(d).collect()}
    assert totals == {i: len(brute_sentences(t)) for i, t in rows}
    # a run of 50 words that an earlier text holds whole loses words, unless it holds neither a long sentence nor two
    for i, (a, z) in enumerate(runs):
        if any(b <= a and z <= y for b, y in runs[:i]):
            inside = brute_sentences(" ".join(source[a:z]))[1:-1]
            assert i in got or (len(inside) < 2 and sum(map(len, inside)) < 20)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = spark.createDataFrame([(2_000_001, "a <|endoftext|> b"), (2_000_002, "<|endoftext|><|endoftext|>x <|endoftext| >")], "doc_id long, text string")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs.where("doc_id IS NOT NULL AND doc_id > 2").selectExpr("doc_id + 1000000 AS doc_id", "text")).unionByName(added)
    texts = dict(table.collect())
    rows = packing.pack(table).collect()
    pieces, filled = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at:at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_differencing_is_nearly_equal():
    sizes = np.random.default_rng(0).integers(1, 257, 400).tolist()
    parts = packing.divide(sizes, 1024)
    assert sorted(i for p in parts for i in p) == list(range(400))
    totals = [sum(sizes[i] for i in p) for p in parts]
    assert max(totals) <= 1024 and max(totals) - min(totals) < 40


def test_maximal_segments_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(100):
        s = np.round(rng.normal(-0.2, 1, 30), 2)
        total = np.concatenate([[0.0], np.cumsum(s)])
        found = toxicity.maximal_segments(total, np.flatnonzero(s > 0))
        best = max((total[j] - total[i] for i in range(30) for j in range(i + 1, 31)), default=0)
        if best > 0:
            assert max(f[2] for f in found) == pytest.approx(best)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("op,label,floor", [(toxicity.op1_toxicity, "toxic", 0.9), (compression.op8_quality, "quality", 0.85)])
def test_held_out_accuracy(spark, op, label, floor):
    sf = "/root/testdata/sf0.01"
    rows = op(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert rows.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= floor


def test_language(spark, docs):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train_model(table, ~langid.is_fold(F.col("doc_id"), 3, 1), per_lang=60)
    held = langid.identify(table.where(langid.is_fold(F.col("doc_id"), 3, 1)), model).join(table.select("doc_id", "lang"), "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    und = {r.doc_id: r.lang_pred == "und" for r in langid.identify(docs, model).collect()}
    assert [und[i] for i in (3, 4, 5, 8, 7, 6)] == [True] * 4 + [False] * 2


def test_blocks_do_not_change_posteriors():
    rng = np.random.default_rng(0)
    score, moves = rng.normal(size=(150, 3)).astype(np.float32), rng.normal(size=(3, 3))
    got = langid.posteriors(score, np.array([0, 70, 70, 150]), moves)
    a = np.exp(moves) / np.exp(moves).sum(axis=1, keepdims=True)
    for lo, hi in ((0, 70), (70, 150)):
        e, f = np.exp(score[lo:hi].astype(float)), [np.full(3, 1 / 3)]
        for x in e:
            f.append((f[-1] @ a) * x)
            f[-1] /= f[-1].sum()
        b = np.ones(3)
        for i in range(hi - lo - 1, -1, -1):
            p = f[i + 1] * b
            assert np.allclose(got[lo + i], p / p.sum(), atol=1e-3)
            b = a @ (e[i] * b)
            b /= b.sum()


def test_trained_operators_on_edge_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for found in (toxicity.toxic_passages(docs, toxicity.train_model(docs, labels, F.lit(True))),
                  compression.quality(docs, compression.train_model(docs, labels, F.lit(True)))):
        rows = found.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0 and not decontaminate.decontaminate(docs, bench).where("contaminated").count()
    assert ngram_join.ngram_components(none).count() == 0
    assert sentence_dedup.sentence_dedup(none).count() == 0 and packing.pack(none).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "a", "Hello  there\n\nsecond line"), (1, 1, "b", "> hello there\n> Second line\nYes."), (1, 2, "a", ">> second line\n> yes.\nOn Monday b wrote:\nBye"),
            (1, 3, "c", "> never said\nNew"), (None, 0, "x", None), (2, 0, "u", "Yes."), (1, 0, "a", "Hello  there\n\nsecond line")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    r = got[1, 2]
    assert (r.text, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth, r.position) == ("Bye", 2, 2, 1, 0, 2, 3)
    assert (got[1, 3].reply_to, got[1, 3].thread, got[1, 3].n_quotes, got[None, 0].text) == (None, 3, 1, "")


def test_revisits(spark):
    rows = [(1, "http://www.A.com/x/?utm_a=1&b=2#f", 100, 200, {"ETag": '"1"', "Content-Type": "t"}, "body"),
            (2, "https://a.com/x?b=2", 100 + 5 * 86400, 304, {"etag": 'W/"1"', "Date": "d", "Content-Length": "0"}, None),
            (3, "a.com/x?b=2", 200 + 5 * 86400, 304, {"etag": '"2"'}, None), (4, "a.com/none", 300, 304, None, None), (5, None, 1, 200, None, "z")]
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(
        rows, "record_id long, url string, ts long, status int, headers map<string,string>, payload string")).collect()}
    assert (got[2].outcome, got[2].response_id, got[2].payload) == ("resolved", 1, "body")
    assert got[2].headers == {"etag": 'W/"1"', "date": "d", "content-type": "t"}
    assert [got[i].outcome for i in (3, 4, 5)] == ["validator_mismatch", "no_response", "stored"] and got[5].kind == "other"


def test_stages_tell_rows_apart_by_text(spark, tmp_path):
    """Null and repeated doc_ids of different texts: decontaminate drops only
    the contaminated rows, the n-gram join all of a component but one."""
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    near = lambda c, end: text(c) + " " + end
    rows = [(1, text("a")), (1, near("b", "x")), (1, near("b", "y")), (2, text("b")), (2, text("c")), (3, text("d")),
            (3, near("a", "z")), (None, text("e")), (None, near("e", "x")), (None, text("f")), (None, near("d", "x")),
            (5, text("g")), (5, text("g")), (6, near("g", "x")), (None, None), (7, ""), (8, " ")]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, digest string")

    spark.createDataFrame([(1, text("b", 12)), (2, text("e", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontaminate.stage(spark, d, str(tmp_path))
    assert clean.columns == d.columns
    bad = lambda t: (t or "").startswith(("b0 ", "e0 "))
    assert by_id(clean.select("doc_id", "text").collect()) == by_id([r for r in rows if not bad(r[1])])

    left = ngram_join.stage(spark, d, str(tmp_path))
    assert left.columns == d.columns
    got = [tuple(r)[:2] for r in left.collect()]
    families = lambda rs: sorted((t or " ")[0] for _, t in rs)
    assert families(got) == sorted([*"abcdefg", " ", " ", " "]) and set(got) <= set(rows)
    assert {(1, text("a")), (2, text("c")), (3, text("d")), (None, text("f")), (5, text("g"))} <= set(got)
    assert [i for i, t in got if (t or "").startswith("b0")] == [1]


def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = exact_dedup.stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.select("text").distinct().count()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_regular_patterns_of_bytes_do_not_collide():
    """A Thue-Morse word and its complement have equal polynomial hashes
    modulo 2^64 whatever the base."""
    from vigil.llm import textbytes as tb
    for bits in (10, 12, 20):
        odd = np.bitwise_count(np.arange(1 << bits, dtype=np.uint32)) & 1
        both = np.concatenate([97 + odd, 98 - odd]).astype(np.uint8)
        n = 1 << bits
        for seed in (0, 1):
            h = tb.span_hashes(both, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert h[0] != h[1]
            # the same range alone, whatever block it falls into
            assert (tb.span_hashes(both[n:], np.array([0]), np.array([n]), seed) == h[1:]).all()
    x = np.arange(3000, dtype=np.uint64) * np.uint64(1 << 40)
    a, z = np.arange(0, 2900, 7), np.arange(0, 2900, 7) + np.arange(415) % 50
    assert (tb.span_hashes(x, a, z) == np.concatenate([tb.span_hashes(x, a[i:i + 1], z[i:i + 1]) for i in range(len(a))])).all()


def test_words_of_regular_patterns_stay_apart(spark):
    odd = np.bitwise_count(np.arange(1024, dtype=np.uint32)) & 1
    one, two = (bytes((97 + b if flip else 98 - b) for b in odd.tolist()).decode() for flip in (True, False))
    text = lambda w: f"{w} p q r s t u v. Then {w} a b c d e f g h i j k l m n o p q r s t u v w x y."
    d = spark.createDataFrame([(1, f"{one} p q r s"), (2, f"{two} p q r s")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.ngram_components(d).collect()} == {(1, 1, 1), (2, 1, 2)}
    e = spark.createDataFrame([(1, text(one)), (2, text(two)), (3, text(one))], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in sentence_dedup.sentence_dedup(e).collect()} == {(1, 0), (2, 0), (3, 2)}
