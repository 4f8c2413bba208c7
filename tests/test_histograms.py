"""Histograms of the boosting: sums over sampled rows, counted once a pair."""

import numpy as np
import pytest

from vigil.functions import blocks as B
from vigil.operators import boosting

CLASSES = {"two": 2, "four": 4}


def test_every_level_has_the_sums_of_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 700)  # blocks are cut and joined
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random()), float(rng.integers(0, 5)), None if i % 9 == 0 else float(rng.random()), int(rng.integers(0, 2)), int(rng.integers(0, 4))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, two int, four int").repartition(3).persist()
    names = ["a", "b", "c"]
    seen, real = [], boosting._histogram

    def spy(base, model, recent, level, growing, width, share, salt, above=None):
        got = real(base, model, recent, level, growing, width, share, salt, above)
        want = np.zeros_like(got)
        for b in base.toArrow().to_batches():
            for i in range(b.num_rows):
                x, y, key = B.unpack(b, i, 3, 2, np.uint8)
                score = boosting.add_trees(np.tile(model.start, (len(x), 1)), x, model.rounds)
                g, h = (np.rint(v * boosting.UNIT) for v in boosting.gradients(score, y, CLASSES))
                for r in np.flatnonzero(B.hash_share(key, salt) < share):
                    for k in range(5):
                        node = boosting.leaf_of(x[r:r + 1], growing[0][k], growing[1][k], level)[0]
                        for j in range(3):
                            want[k, node, j, x[r, j]] += (g[r, k], h[r, k], 1)
        assert np.array_equal(got, want)
        seen.append((level, above is not None))
        return got
    monkeypatch.setattr(boosting, "_histogram", spy)
    boosting.fit_boosting(df, names, CLASSES, ["id"], rounds=2, depth=3, rate=0.5, subsample=0.7)
    assert seen == [(0, False), (1, True), (2, True)] * 2


def test_curvatures_and_rows_of_a_full_chunk_do_not_meet():
    n = boosting.CHUNK
    x, h = np.zeros((n, 1), np.uint8), np.full(n, boosting.UNIT / 4)
    out = np.zeros((3, 1, 1, 2))
    boosting._cells(x, np.full(n, -boosting.UNIT), h, None, 1, 2, out)
    assert out[:, 0, 0, 0].tolist() == [-n * boosting.UNIT, n * boosting.UNIT / 4, n] and not out[:, 0, 0, 1].any()
    assert n * boosting.UNIT / 4 < boosting.ROW and n * boosting.ROW < 2 ** 53


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_no_rows_and_all_rows_in_chunks(share):
    import pyarrow as pa
    x, y, key = np.arange(30, dtype=np.uint8).reshape(10, 3), np.zeros((10, 2), np.int32), np.arange(10, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, key)], names=["x", "y", "key"])
    got = list(boosting._chunks([batch, batch], 3, 5, np.zeros(5), 2, share, 1))
    assert sum(len(a) for a, _, _ in got) == 20 * share
