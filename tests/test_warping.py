"""Batch warping kernels against loops over single cells."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import cluster, warping


def cost_table(c, x):
    """Accumulated cost by the recurrence, cell by cell."""
    acc = {(-1, -1): 0.0}
    at = lambda i, j: acc.get((i, j), math.inf)
    for i in range(len(c)):
        for j in range(len(x)):
            acc[i, j] = (c[i] - x[j]) ** 2 + min(at(i - 1, j - 1), at(i - 1, j), at(i, j - 1))
    return acc


def soft_value(c, x, gamma):
    acc = {(-1, -1): 0.0}
    for i in range(len(c)):
        for j in range(len(x)):
            before = [acc[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in acc]
            low = min(before)
            acc[i, j] = (c[i] - x[j]) ** 2 + low - gamma * math.log(sum(math.exp((low - v) / gamma) for v in before))
    return acc[len(c) - 1, len(x) - 1]


SIZES = [(1, 1), (1, 6), (6, 1), (5, 5), (7, 4), (4, 9)]


@pytest.mark.parametrize("n,m", SIZES)
def test_costs_and_paths_equal_the_cell_loop(n, m):
    rng = np.random.default_rng(n * 10 + m)
    c, x = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, (8, m)).astype(float)  # with ties
    costs, (total, count) = warping.dtw_costs(c, x), warping.align(c, x)
    for k, row in enumerate(x):
        acc = cost_table(c, row)
        assert costs[k] == acc[n - 1, m - 1]
        sums, counts, i, j = np.zeros(n), np.zeros(n), n - 1, m - 1
        while i >= 0 and j >= 0:
            sums[i] += row[j]
            counts[i] += 1
            i, j = min(((acc.get(p, math.inf), o, p) for o, p in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1)))))[2]
        assert (sums == total[k]).all() and (counts == count[k]).all()


@pytest.mark.parametrize("n,m", SIZES)
@pytest.mark.parametrize("gamma", [0.01, 0.7, 20.0])
def test_soft_costs_and_gradients(n, m, gamma):
    rng = np.random.default_rng(n + m)
    c, x = rng.normal(size=n), rng.normal(size=(5, m))
    value, grad = warping.soft_costs(c, x, np.full(5, gamma), True)
    for k, row in enumerate(x):
        assert value[k] == pytest.approx(soft_value(c, row, gamma))
        for i in range(n):
            step = np.eye(n)[i] * 1e-6
            slope = (soft_value(c + step, row, gamma) - soft_value(c - step, row, gamma)) / 2e-6
            assert grad[k, i] == pytest.approx(slope, abs=2e-3 if gamma < 0.1 else 1e-5)


def test_bounds_skip_centroids_and_keep_the_nearest():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 30)), rng.normal(size=(40, 30)) + 20])
    cents = [rng.normal(size=25), rng.normal(size=30) + 20, rng.normal(size=30) + 40]
    full = np.stack([warping.dtw_costs(c, x) for c in cents], axis=1)
    for k, c in enumerate(cents):
        assert (warping.lower_bounds(c, x) <= full[:, k] + 1e-9).all()
    at, cost, measured = warping.nearest(cents, x)
    assert (at == full.argmin(axis=1)).all() and (cost == full.min(axis=1)).all() and measured < 1.5 * len(x)
    same = warping.nearest([cents[0], cents[0]], x)
    assert (same[0] == 0).all()  # ties go to the first


def test_long_series_are_measured_many_times_faster_than_cell_by_cell():
    rng = np.random.default_rng(4)
    c, x = rng.normal(size=720).cumsum(), rng.normal(size=(24, 720)).cumsum(axis=1)
    began = time.perf_counter()
    acc = cost_table(c, x[0])
    loop = time.perf_counter() - began
    began = time.perf_counter()
    costs = warping.dtw_costs(c, x)
    batch = (time.perf_counter() - began) / len(x)
    assert costs[0] == pytest.approx(acc[719, 719]) and loop > 20 * batch


def test_nearest_series_of_a_table(spark):
    """Two keys with centroids of their own, unequal lengths, ties."""
    rng = np.random.default_rng(5)
    series = [(s, i, rng.normal(size=int(rng.integers(3, 6))).tolist()) for s in "uv" for i in range(12)]
    cents = [(s, k, rng.normal(size=4).tolist()) for s in "uv" for k in (0, 1)] + [("v", 2, None)]
    cents[-1] = ("v", 2, cents[3][2])  # the same as cluster 1
    a = spark.createDataFrame(series, "sensor string, chunk_id int, vals array<double>")
    b = spark.createDataFrame(cents, "sensor string, cluster int, vals array<double>")
    hard = {(r.sensor, r.chunk_id): (r.cluster, r.dist) for r in cluster.dtw_assign(a, b, "sensor").collect()}
    soft = {(r.sensor, r.chunk_id): (r.cluster, r.dist) for r in cluster.softdtw_assign(a.withColumn("gamma", F.lit(0.5)), b, "sensor").collect()}
    for s, i, v in series:
        own = [(k, c) for t, k, c in cents if t == s]
        costs = [(cost_table(c, v)[len(c) - 1, len(v) - 1], k) for k, c in own]
        assert hard[s, i][0] == min(costs)[1] and hard[s, i][1] == pytest.approx(min(costs)[0])
        values = [(round(soft_value(c, v, 0.5), 9), k) for k, c in own]
        assert soft[s, i][0] == min(values)[1] and soft[s, i][1] == pytest.approx(min(values)[0])


def test_barycenter_moves_towards_its_series(spark):
    rows = [("s", i, [0.0, 0.0, 1.0, 2.0 + i, 1.0, 0.0]) for i in range(3)]
    a = spark.createDataFrame(rows, "sensor string, chunk_id int, vals array<double>").withColumn("cluster", F.lit(0))
    cents = spark.createDataFrame([("s", 0, [0.0, 0.0, 1.0, 1.0, 1.0, 0.0])], "sensor string, cluster int, vals array<double>")
    new = cluster.dba_update(a, cents, "sensor", 1).first()["vals"]
    cost = lambda c: sum(warping.dtw_distance(c, r[2]) for r in rows)
    assert cost(new) < cost([0.0, 0.0, 1.0, 1.0, 1.0, 0.0])
