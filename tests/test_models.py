"""Trained models: brute-force twins, gradients, planted structure, floors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from vigil.operators import boosting, classify, detect, forest, neural, stats

FEATURES = ["a", "b", "c"]
CLASSES = {"two": 2, "three": 3}


@pytest.fixture(scope="module")
def table(spark):
    """Classes that need two splits; some null features, one constant one."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        a, b = rng.random(2)
        two = int((a > 0.5) != (b > 0.5))
        three = 0 if a < 0.3 else 1 if b < 0.5 else 2
        rows.append((i, float(a), float(b) if i % 50 else None, 7.0, two, three))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, two int, three int").repartition(3).persist()


def accuracy(pred, t):
    return pred.agg(F.avg((F.col(t) == F.col(f"pred_{t}")).cast("int"))).first()[0]


# ------------------------------------------------------------------ boosting
def test_best_split_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cells = np.concatenate([rng.normal(size=(4, 9, 1)), rng.random((4, 9, 1)), rng.integers(0, 3, (4, 9, 1))], axis=2)
        cells[cells[..., 2] == 0] = 0
        n = cells[0, :, 2].sum()
        cells[1:, :, :] = cells[rng.permutation(1).repeat(3)][:, rng.permutation(9)]
        best = (0.0, -1, 0)
        for j in (0, 2, 3):
            for b in range(9):
                left, right = cells[j, :b + 1].sum(axis=0), cells[j, b + 1:].sum(axis=0)
                if left[2] and right[2]:
                    gain = left[0] ** 2 / left[2] + right[0] ** 2 / right[2] - (left[0] + right[0]) ** 2 / n
                    if gain > best[0] + 1e-12:
                        best = (gain, j, b)
        j, b, left, right, gain = boosting.best_split(cells, {0, 2, 3})
        assert gain == pytest.approx(best[0], abs=1e-9) and (j == best[1] or gain == pytest.approx(best[0]))


def test_boosting_learns_and_does_not_depend_on_partitions(table):
    one = boosting.fit_boosting(table, FEATURES, CLASSES, ["id"], rounds=4, depth=2, rate=0.5)
    two = boosting.fit_boosting(table.repartition(7, "a"), FEATURES, CLASSES, ["id"], rounds=4, depth=2, rate=0.5)
    for (f, c, leaf), (g, e, other) in zip(one.rounds, two.rounds, strict=True):
        assert (f == g).all() and (c == e).all() and np.allclose(leaf, other, atol=1e-9)
    pred = boosting.predict_boosting(one, table)
    assert pred.columns == [*table.columns, "pred_two", "pred_three"] and pred.count() == 1500
    assert accuracy(pred, "two") > 0.9 and accuracy(pred, "three") > 0.9


def test_boosting_rebases_its_scores(table, monkeypatch):
    plain = boosting.fit_boosting(table, FEATURES, {"three": 3}, ["id"], rounds=3, depth=1, subsample=0.8, max_features=0.7)
    monkeypatch.setattr(boosting, "REBASE", 1)
    often = boosting.fit_boosting(table, FEATURES, {"three": 3}, ["id"], rounds=3, depth=1, subsample=0.8, max_features=0.7)
    for (f, c, leaf), (g, e, other) in zip(plain.rounds, often.rounds, strict=True):
        assert (f == g).all() and (c == e).all() and np.allclose(leaf, other)


def brute_samme(x, y, k, rounds):
    """SAMME over all cuts between neighbouring values."""
    w, votes = np.full(len(y), 1 / len(y)), np.zeros((len(y), k))
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                sides = [np.bincount(y[s], w[s], k) for s in (left, ~left)]
                pure = sum((s ** 2).sum() / s.sum() for s in sides)
                if best is None or pure > best[0] + 1e-12:
                    best = (pure, left, sides[0].argmax(), sides[1].argmax())
        pred = np.where(best[1], best[2], best[3])
        error = max((w * (pred != y)).sum() / w.sum(), 1e-10)
        if error >= 1 - 1 / k:
            break
        alpha = np.log((1 - error) / error) + np.log(k - 1)
        votes[np.arange(len(y)), pred] += alpha
        w = w * np.exp(alpha * (pred != y))
        w /= w.sum()
    return votes.argmax(axis=1)


def test_adaboost_matches_samme(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 2)).astype(float)
    y = np.where(x[:, 0] + x[:, 1] < 8, 0, np.where(x[:, 0] > 7, 1, 2))
    y[rng.random(300) < 0.05] = 0
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int").repartition(3)
    model = boosting.fit_adaboost(df, ["a", "b"], {"y": 3}, ["id"], rounds=12)
    got = dict(boosting.predict_adaboost(model, df).select("id", "pred_y").collect())
    assert len(model.rounds["y"]) == 12 and np.mean([got[i] == v for i, v in enumerate(brute_samme(x, y, 3, 12))]) > 0.99


def test_models_of_odd_targets(spark):
    """One class only, a null class, constant features, a null in the rows to predict."""
    df = spark.createDataFrame([(i, 1.0, None if i % 2 else 2.0, 1, i % 2) for i in range(40)] + [(99, 1.0, 1.0, None, 0)], "id long, a double, b double, same int, odd int")
    for pred in (boosting.predict_boosting(boosting.fit_boosting(df, ["a", "b"], {"same": 2, "odd": 2}, ["id"], rounds=2, depth=1, rate=1.0), df),
                 boosting.predict_adaboost(boosting.fit_adaboost(df, ["a", "b"], {"same": 2, "odd": 2}, ["id"], rounds=3), df)):
        rows = pred.where("id < 99").collect()
        assert {r.pred_same for r in rows} == {1} and all(r.pred_odd == r.odd for r in rows)


# ------------------------------------------------------------------- networks
@pytest.mark.parametrize("activation", ["identity", "logistic", "tanh", "relu"])
@pytest.mark.parametrize("classes", [2, 4])
def test_gradient_equals_finite_differences(activation, classes):
    rng = np.random.default_rng(3)
    layers = neural.shapes(3, (5, 4), classes)
    w, x, y = neural.initial(layers, 1), rng.normal(size=(20, 3)), rng.integers(0, classes, 20)
    _, g = neural.loss_gradient(w, layers, x, y, activation)
    for i in rng.permutation(len(w))[:25]:
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (neural.loss_gradient(w + s * step, layers, x, y, activation)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_distributed_gradient_is_that_of_all_rows(table):
    net = neural.fit_mlp(table.na.drop(), FEATURES, CLASSES, ["id"], hidden=(4,), solver="lbfgs", max_iter=3)
    rows = table.na.drop().toPandas()
    x = neural.scaled(rows[FEATURES].to_numpy(float), net.low, net.span)
    assert (x[:, 2] == 0).all()  # a constant feature is 0
    from vigil.functions import blocks as B
    base = B.blocks(table.na.drop(), FEATURES, CLASSES, ["id"], lambda v: neural.scaled(v, net.low, net.span))
    got = neural.objective(base, net, net.weights, 0.0)
    for t in CLASSES:
        loss, g = neural.loss_gradient(net.weights[t], net.layers[t], x, rows[t].to_numpy(), net.activation)
        assert got[t][0] == pytest.approx(loss / len(x)) and np.allclose(got[t][1], g / len(x))


@pytest.mark.parametrize("params", [dict(solver="adam", activation="relu", early_stopping=True), dict(solver="sgd", rate=0.3, schedule="adaptive"), dict(solver="lbfgs", max_iter=60)])
def test_networks_learn(table, params):
    net = neural.fit_mlp(table, FEATURES, CLASSES, ["id"], hidden=(12,), **({"max_iter": 300, "local": 30} | params))
    pred = neural.predict_mlp(net, table)
    assert net.losses[-1]["two"] < 0.7 * net.losses[0]["two"] and accuracy(pred, "two") > 0.85 and accuracy(pred, "three") > 0.85


# --------------------------------------------------------------------- search
def test_guided_trials_are_at_least_as_good_as_random():
    bounds = {"x": (0.0, 1.0), "n": (1, 30), "kind": ["p", "q", "r"]}
    surface = lambda p: -(p["x"] - 0.7) ** 2 - ((p["n"] - 12) / 30) ** 2 + 0.1 * (p["kind"] == "q")
    guided, plain = [], []
    for seed in range(12):
        found = classify.guided_search(surface, bounds, 20, 5, seed, parallelism=1)
        assert [t["guided"] for t in found] == [False] * 20 + [True] * 5
        assert all(0 <= t["params"]["x"] <= 1 and t["params"]["n"] in range(1, 31) for t in found)
        guided.append(max(t["value"] for t in found))
        rng = random.Random(seed)
        plain.append(max(surface(classify.draw(bounds, rng)) for _ in range(25)))
    assert np.mean(guided) >= np.mean(plain)


def test_search_of_a_family(table):
    found = classify.search(table, "adaboost", "three", CLASSES, FEATURES, ["id"], n_random=2, n_guided=1, fixed={"n_estimators": 3})
    assert [t["guided"] for t in found] == [False, False, True] and all(50 < t["value"] <= 100 for t in found)
    for kind in ("gbt", "adaboost", "forest", "mlp"):
        p = classify.draw(classify.space(kind, 7), random.Random(1))
        assert classify.model_params(kind, p)
    assert len(classify.model_params("mlp", p)["hidden"]) == p["layers"]


# --------------------------------------------------------------------- forest
def sensor_rows(spark, n=900):
    rng = np.random.default_rng(4)
    rows = [(0, s, p, float(rng.normal() * (1 + k))) for k, s in enumerate(("u", "v")) for p in range(n)]
    planted = {("u", 850): 9.0, ("u", 870): -8.0, ("v", 880): 30.0}
    rows = [(f, s, p, planted.get((s, p), v)) for f, s, p, v in rows]
    return spark.createDataFrame(rows, "fold int, sensor string, pos long, value double").withColumn("role", F.when(F.col("pos") < 800, "train").otherwise("test")), planted


def test_forest_steps_are_the_mean_of_the_trees(spark):
    x, _ = sensor_rows(spark, 300)
    sizes = spark.createDataFrame([(0, "u", 64, 20), (0, "v", 500, 3)], "fold int, sensor string, samples long, trees long")
    samples = forest.forest_samples(x, sizes)
    counts = {(r.sensor, r.tree): r.n for r in samples.groupBy("sensor", "tree").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 23 and all(n == 300 if s == "v" else 45 < n <= 64 for (s, _), n in counts.items())
    steps = forest.forest_steps(samples)
    own = steps.where("sensor = 'u'").orderBy("from").toPandas()
    assert own["from"].iloc[0] == -np.inf and own["trees"].iloc[-1] == 20
    import zlib
    total, norm = {v: 0.0 for v in (-2.0, 0.1, 0.5, 3.0)}, 0.0
    for tree, g in samples.where("sensor = 'u'").toPandas().groupby("tree"):
        salt = int(np.random.SeedSequence([0, zlib.crc32(repr(("0", "u")).encode()), int(tree)]).generate_state(1)[0])
        lo, _, path = detect._tree_leaves(np.sort(g["value"].to_numpy()), salt)
        norm += float(detect._c(len(g)))
        for v in total:
            total[v] += path[np.searchsorted(lo, v, side="right") - 1]
    probe = spark.createDataFrame([(0, "u", v) for v in total] + [(0, "u", None), (0, "w", 1.0)], "fold int, sensor string, value double")
    for piece in (4, 256):
        got = {(r.sensor, r.value): r.score for r in forest.forest_scores(probe, steps, piece=piece).collect()}
        assert got[("u", None)] is None and got[("w", 1.0)] is None
        for v, path in total.items():
            assert got[("u", v)] == pytest.approx(2 ** (-path / norm))


def test_forest_finds_planted_anomalies(spark):
    from vigil.plans.q_detect import forest_z
    x, planted = sensor_rows(spark)
    x = x.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    sizes = spark.createDataFrame([(0, "u", 128, 64), (0, "v", 128, 64)], "fold int, sensor string, samples long, trees long")
    rows = forest_z(x, sizes).collect()
    assert len(rows) == 200
    top = {(r.sensor, r.pos) for s in "uv" for r in sorted((r for r in rows if r.sensor == s), key=lambda r: -r.score)[:2]}
    assert set(planted) <= top, top
    # a reading beyond all others shares the outermost leaves of its side, which a
    # tail on the other side may outscore
    assert sum(r.z > 3 for r in rows if (r.sensor, r.pos) in planted) >= 2


def test_forest_plan_never_groups_readings(spark):
    x, _ = sensor_rows(spark, 50)
    sizes = spark.createDataFrame([(0, "u", 16, 4)], "fold int, sensor string, samples long, trees long")
    steps = forest.forest_steps(forest.forest_samples(x, sizes))
    scored = forest.forest_scores(x, spark.createDataFrame(steps.collect(), steps.schema))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


# --------------------------------------------------------------------- floors
def test_reports_of_both_tables(spark):
    from vigil.plans import q_classify as q
    for table, names in (("machine", ("gbt", "adaboost", "mlp")), ("lines", ("adaboost", "forest"))):
        for kind in names:
            few = {"gbt": {"n_estimators": 4, "learning_rate": 0.5}, "adaboost": {"n_estimators": 5}, "mlp": {"max_iter": 200}, "forest": {"n_estimators": 5}}[kind]
            r = {x.target_name: x for x in q._fit(kind, table, few)(spark, SF_SMALL).collect()}
            assert set(r) == {"target", "failure_type"}
            if table == "machine":  # the line faults' classes do not follow from the measures
                assert r["target"].balanced_accuracy > 80 and r["failure_type"].micro_f1 > 75
            else:
                assert r["target"].micro_f1 > 55
    assert stats.confusion is not None
