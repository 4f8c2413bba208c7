"""Resampling and the vector operators against brute force, with edge rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vigil.llm")

from vigil.llm import lattice, resampling, vector_codes  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- resampling
def features(text):
    words = WORD.findall((text or "").translate(A_TO_Z))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent=5):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in docs:
        n, found = features(x)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for at, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = at + 1
    return sorted(map(tuple, out), key=str)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


def test_resampling_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "日本語", "x" * 63, "y" * 64, "z" * 65, "long" * 400]
    rows = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in rng.permutation(400)]
    rows += [(1000, None), (1001, ""), (1002, " -- "), (None, " ".join(vocabulary[:40])), (1003, " ".join(vocabulary * 200))]
    target = [" ".join(rng.choice(vocabulary[:50], 30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = resampling.resample(docs, bench, percent=30).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, 30)


def test_resampling_of_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(7, text)] * 40, "doc_id long, text string")
    assert resampling.resample(none, docs).collect() == []
    got = resampling.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len({r["score"] for r in got}) == 1


def test_crc_of_runs_is_that_of_the_joined_words():
    text = b"ab " + b"c" * 200 + b" d " + b"e" * 64
    data = np.frombuffer(text, np.uint8)
    starts = np.array([0, 3, 204, 206])
    ends = np.array([2, 203, 205, 270])
    got = [b for b, _ in resampling.run_buckets(data, starts, ends, np.array([0, 4]), 4294967291)]
    words = text.split(b" ")
    assert [list(b) for b in got] == [[zlib.crc32(b" ".join(words[i:i + n])) % 4294967291 for i in range(5 - n)] for n in (1, 2, 3)]


def test_few_samples_give_the_same_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), int(i), n) for n, (s, i) in enumerate(zip(rng.integers(0, 9, 3000), rng.permutation(3000), strict=True))]
    table = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(6)
    runs = table.sortWithinPartitions(*resampling._order())
    got = {r["row"]: r["rank"] for r in resampling.exact_ranks(runs, F.col("score") != 4, 700, samples=20).collect()}
    order = sorted((r for r in rows if r[0] != 4), key=lambda r: (-r[0], r[1]))
    assert len(got) == 3000 and {k: v for k, v in got.items() if v} == {r[2]: n + 1 for n, r in enumerate(order[:700])}


# ---------------------------------------------------------------- lattice
def test_nearest_lattice_point_is_the_nearest():
    x = np.random.default_rng(0).normal(size=(2000, 8)) * 3
    p = lattice.nearest_point(x)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.allclose(p.sum(axis=1) % 2, 0)
    assert (np.allclose((p % 1).max(axis=1), (p % 1).min(axis=1)))
    around = p[:, None] + lattice.minimal_vectors()[None]  # nearest if no facet of its cell is crossed
    assert (((x[:, None] - around) ** 2).sum(axis=2) >= ((x - p) ** 2).sum(axis=1)[:, None] - 1e-9).all()


def brute_links(rows, cosine=0.98):
    def vector(r):
        ok = r[1] is not None and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[2]) and any(r[2])
        return np.array(r[2], float) / max(map(abs, r[2])) if ok else None
    v = [vector(r) for r in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and v[a] is not None and v[b] is not None and rows[a][1] == rows[b][1] and len(v[a]) == len(v[b]):
                near[a, b] = v[a] @ v[b] / math.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= cosine
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(near[todo.pop()]):
                if b not in seen:
                    seen.add(int(b))
                    todo.append(int(b))
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        root = min(ids) if ids else None
        out.append((rows[a][0], int(near[a].sum()), root, rows[a][0] == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_lattice_links_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows), int(c % 3), (centre + rng.normal(size=24) * 0.12).tolist()))
    rows += [(900 + i, 0, rows[0][2]) for i in range(5)] + [(900, 0, rows[0][2]), (None, 0, rows[0][2]), (None, 1, None)]
    rows += [(950, None, rows[0][2]), (951, 0, None), (952, 0, []), (953, 0, [0.0] * 24), (954, 0, [math.nan] + [1.0] * 23),
             (955, 0, [None] + [1.0] * 23), (956, 0, rows[0][2][:10]), (957, 0, [math.inf] * 24), (958, 1, [-0.0, 1e300] + [0.0] * 22), (959, 1, [0.0, 1e-300] + [0.0] * 22)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit(1)).withColumn("node", F.lit("x")).repartition(3)
    got = lattice.near_vectors(table, block=block).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_lattice_of_an_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).collect() == []


def test_lattice_recall_at_the_threshold():
    """Pairs of cosine 0.98 exactly: at least 0.999 of them meet in a cell."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    zero = np.zeros(len(x), np.int64)
    a, b = (np.stack([lattice.cells(v, zero, t) for t in range(lattice.TABLES)], axis=1) for v in (x, lattice.unit(y)))
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.999


# ---------------------------------------------------------------- vector codes
def brute_codes(rows, entries=16, rounds=6):
    keep = sorted((r for r in rows if r[2] is not None and r[2] and all(v is not None and math.isfinite(v) for v in r[2])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.floor(np.array([r[2] for r in keep]) * 4096).astype(np.int64).reshape(len(keep), 8, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        own = d.argmin(axis=2)
        for p in range(8 if r < rounds else 0):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    error = d.min(axis=2).sum(axis=1)
    return sorted([(r[0], r[1], own[i].tolist(), int(error[i])) for i, r in enumerate(keep)], key=str), books


@pytest.mark.parametrize("n", [9, 700])
def test_vector_codes_match_a_full_search(spark, n):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(0, 3)), (rng.integers(-3, 4, 16) / 4 if i % 2 else rng.normal(size=16)).tolist()) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (None, None, rows[1][2])]  # repeated rows, ties, nulls
    bad = [(3, 0, None), (4, 0, [math.nan] * 16), (5, 0, [None] + [1.0] * 15), (6, 0, [math.inf] + [0.0] * 15)]
    short = [(2000, 0, [1.0] * 8), (2001, 0, [1.0] * 5), (2002, 0, [])]
    table = spark.createDataFrame(rows + bad + short, "vec_id long, label int, embedding array<double>").withColumn("parts", F.lit(0)).repartition(3)
    codes, books, log = vector_codes.vector_codes(table)
    want, want_books = brute_codes(rows)
    assert (books == want_books).all()
    assert sorted([(r["vec_id"], r["label"], r["ids"], r["error"]) for r in codes.collect()], key=str) == want
    lengths = [a for a, _ in log]
    assert lengths == sorted(lengths, reverse=True)


def test_bounds_spare_distances(spark):
    """Clustered parts: after some rounds most assignments need one distance."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(16, 16)) * 5
    rows = [(i, 0, (centre[i % 16] + rng.normal(size=16) * 0.1).tolist()) for i in range(800)]
    _, _, log = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    length, used = log[-1]
    assert used.get(1, 0) > 0.9 * sum(used.values()) and length < vector_codes.LISTED


def test_vector_codes_of_empty_tables(spark):
    kind = "vec_id long, label string, embedding array<float>"
    for rows in ([], [(1, "a", None)], [(1, "a", [])], [(1, "a", [1.0, 2.0])]):
        codes, _, _ = vector_codes.vector_codes(spark.createDataFrame(rows, kind))
        assert codes.collect() == [] and codes.columns == ["vec_id", "label", "ids", "error"]


def test_label_errors_add_up(spark, tmp_path):
    rows = [(i, i % 2 if i % 5 else None, np.random.default_rng(i).normal(size=8).tolist()) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    label = {r[0]: r[1] for r in rows}
    want = {}
    for r in got:
        want[label[r["vec_id"]]] = want.get(label[r["vec_id"]], 0) + r["error"]
    assert len(got) == 60 and all(r["label_error"] == want[label[r["vec_id"]]] and len(r["code"]) == 16 for r in got)
