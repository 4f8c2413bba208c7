"""Counting and prefix steps of the n-gram join: packed numbers, and only
prefix rows that may meet another one."""

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import ngram_join as nj

ROWS = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]  # meet nothing
ROWS += [(100 + i, " ".join(f"s{i // 2}y{j + i % 2}" for j in range(60))) for i in range(8)]  # pairs


@pytest.mark.parametrize("tokens", [[], [0], [5, 6, 1 << 40, (1 << 40) + 3, (1 << 45) + 1], list(range(0, 90000, 7))])
def test_packed_numbers_come_back(tokens):
    t = np.array(tokens, np.uint64)
    c = (np.arange(len(t)) % 70000).astype(np.int64)
    back, counts = nj.unpack(nj.pack(t, c))
    assert np.array_equal(back, t) and np.array_equal(counts, c.astype(np.uint16))


def test_only_prefix_rows_that_may_meet_are_written(spark):
    d = spark.createDataFrame(ROWS + ROWS[-2:], "doc_id long, text string").repartition(3)
    total, none = 48 * 56, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    send = spark.sparkContext.broadcast
    got = {(r["token"], r["node"]) for r in nj.prefixes(d, send(none), send(nj.shared_bits(d, send(none), total)), total).collect()}
    every = set()
    for t in ROWS:
        batch = pa.RecordBatch.from_pylist([{"doc_id": t[0], "text": t[1]}])
        for v, node, _, _ in nj.doc_prefixes(batch, none, nj.token_bits(total), nj.PERCENT, nj.N):
            every |= set(zip(v.view(np.int64).tolist(), node.tolist()))
    tokens = [t for t, _ in every]
    meet = {(t, n) for t, n in every if tokens.count(t) > 1}
    assert meet and meet <= got <= every and len(got) < len(every) / 2


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    want = sorted(map(tuple, nj.ngram_components(d).collect()))
    monkeypatch.setattr(nj, "MAX_BITS", 4)  # every shingle shares its bit
    assert sorted(map(tuple, nj.ngram_components(d).collect())) == want
    assert sum(r[0] != r[2] for r in want) == 4 and spark.conf.get(key) == before


def test_many_chunks_are_packed_together(monkeypatch):
    rng = np.random.default_rng(5)
    vals = [np.unique(rng.integers(0, (1 << 64) - 1, 3000, dtype=np.uint64)) for _ in range(12)]
    total, bits = sum(map(len, vals)), nj.count_bits(36000 << 4)

    def both(together):
        monkeypatch.setattr(nj, "PACKED", together)
        found = pa.Table.from_batches(list(nj.packs(iter(vals), bits, 3)))
        counts = {}
        for part in range(3):
            t, c = nj.added(found.filter(pa.array([p == part for p in found["part"].to_pylist()])))
            counts |= dict(zip(t.tolist(), c.tolist()))
        return counts, sum(len(b) for b in found["blob"].to_pylist())
    (apart, more), (one, less) = both(1), both(1 << 21)
    assert one == apart and sum(one.values()) == total and less < 0.9 * more


def test_prefix_rows_are_dealt_once(spark):
    rows = [(t, n, 20 + n % 7, (t + n) % 9) for t in range(40) for n in {(t * k) % 23 for k in range(t % 5 + 1)}]
    d = spark.createDataFrame(rows + rows[::3], "token long, node long, size int, pos int")
    got = nj.met(d, 75)
    want = set()
    for t, n, s, p in rows:
        own = [r for r in rows if r[0] == t]
        _, a, x, y = min(own, key=lambda r: r[1])
        fits = a < n and 100 * min(s, x) >= 75 * max(s, x) and 175 * min(s - p, x - y) >= 75 * (s + x)
        if len(own) > 1:
            want.add((t, n, s, p, a if fits else None))
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) and {r[4] is None for r in want} == {True, False}
    assert nj.met(d, 75)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
