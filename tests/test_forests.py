"""Forests on binned rows against trees grown one by one, and what they keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import blocks as B
from vigil.operators import bagging, classify, stats

NAMES, CLASSES = ["a", "b", "c"], {"y": 3, "z": 2}


@pytest.fixture(scope="module")
def rows(spark):
    """Three features (one with few values, one with nulls), repeated and null
    keys, a row without a class."""
    rng = np.random.default_rng(0)
    out = []
    for i in range(900):
        a, b, c = float(rng.random()), float(rng.integers(0, 4)), None if i % 40 == 0 else float(rng.integers(0, 50))
        y = int(a > 0.5) + int(b > 1 and (c or 0) > 20)
        out.append((None if i % 3 == 0 else i // 2, a, b, c, None if i == 7 else y, int(a + b > 2)))
    return spark.createDataFrame(out, "id long, a double, b double, c double, y int, z int").persist()


def plain_tree(x, y, w, widths, k, depth):
    """Nested (feature, cut, left, right) or class counts, row by row."""
    n = np.bincount(y, w, k)
    best = None
    for j, width in enumerate(widths if depth else []):
        for b in range(width - 1):
            left = x[:, j] <= b
            sides = [np.bincount(y[s], w[s], k) for s in (left, ~left)]
            if all(s.sum() for s in sides):
                gain = sum((s ** 2).sum() / s.sum() for s in sides) - (n ** 2).sum() / n.sum()
                if gain > 1e-12 * n.sum() and (best is None or gain > best[0]):
                    best = (gain, j, b, left)
    if best is None:
        return n.tolist()
    return (best[1], best[2], *(plain_tree(x[s], y[s], w[s], widths, k, depth - 1) for s in (best[3], ~best[3])))


def nested(tree, node=0):
    if tree.left[node] == node:
        return tree.counts[node].tolist()
    return (int(tree.feature[node]), int(tree.cut[node]), nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1))


def test_trees_are_those_grown_row_by_row_whatever_the_partitions(rows, monkeypatch):
    cuts, base = bagging.binned(rows, NAMES, CLASSES, ["id"])
    forest = bagging.fit_forest(cuts, base, CLASSES, 6, 4, "all")
    got = [B.unpack(b, i, 3, 2, np.uint8) for b in base.toArrow().to_batches() for i in range(b.num_rows)]
    x, y, key = map(np.concatenate, zip(*got, strict=True))
    assert len(x) == 899
    for t, name in enumerate(CLASSES):
        for i, tree in enumerate(forest.trees[name]):
            w = bagging.draws(key, i, 123)
            assert nested(tree) == plain_tree(x, y[:, t], w, [len(c) + 2 for c in cuts.values()], CLASSES[name], 4)
    monkeypatch.setattr(bagging, "PART_ROWS", 200)  # tasks count some rows at a time
    monkeypatch.setattr(bagging, "OPEN_NODES", 3)  # trees wait for their turn
    again, other = bagging.binned(rows.repartition(7, "a"), NAMES, CLASSES, ["id"])
    two = bagging.fit_forest(again, other, CLASSES, 6, 4, "all")
    for name in CLASSES:
        assert [nested(v) for v in forest.trees[name]] == [nested(v) for v in two.trees[name]]


def test_draws_are_those_of_a_bootstrap_and_differ_between_trees():
    key = np.arange(40_000, dtype=np.int64)
    d = [bagging.draws(key, t, 123) for t in range(6)]
    for v in d:
        assert abs(v.mean() - 1) < 0.03 and abs(v.var() - 1) < 0.05 and abs((v == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(d) - np.eye(6)).max() < 0.02


def test_a_forest_is_the_first_trees_of_a_larger_one_cut_off(rows):
    cuts, base = bagging.binned(rows, NAMES, {"y": 3}, ["id"])
    small, large = bagging.fit_forest(cuts, base, {"y": 3}, 4, 2, "0.6"), bagging.fit_forest(cuts, base, {"y": 3}, 9, 5, "0.6")
    pred = [bagging.predict_forest(f, rows, 4, 2).select("a", "pred_y").collect() for f in (small, large)]
    assert sorted(pred[0]) == sorted(pred[1])
    full = bagging.predict_forest(large, rows, 9, 5).where("y IS NOT NULL")
    assert full.agg(F.avg((F.col("y") == F.col("pred_y")).cast("int"))).first()[0] > 0.9


def test_kept_rows_do_not_grow_with_the_trees(spark, monkeypatch):
    """A row costs its bins, classes and key, however many trees draw it."""
    df = spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    kept, real = [], B.kept
    monkeypatch.setattr(B, "kept", lambda d: kept.append(real(d)) or kept[-1])
    classify.fit_predict(df, df, "forest", {"y": 2}, ["a"], ["id"], {"n_estimators": 60, "max_depth": 2}).count()
    assert len(kept) == 1 and kept[0].agg(F.sum(F.length("x") + F.length("y") + F.length("key"))).first()[0] == 3000 * (1 + 4 + 8)


def test_search_grows_each_tree_once(rows, monkeypatch):
    grown, real = [], bagging._level
    monkeypatch.setattr(bagging, "_level", lambda base, forest, todo: grown.extend((forest.take, t, i, forest.trees["y"][i].levels) for t, i in todo) or real(base, forest, todo))
    found = classify.search(rows.na.drop(subset=["y"]), "forest", "y", CLASSES, NAMES, ["id"], n_random=3, n_guided=1, fixed={"n_estimators": 5}, parallelism=2)
    assert len(found) == 4 and len(grown) == len(set(grown)) <= 2 * 5 * 10


def test_strategies_as_in_mllib():
    assert [bagging.features_per_node(s, 7, 80) for s in ("0.9", "0.8", "1.0", "1", "9", "all", "auto", "sqrt", "log2", "onethird")] == [7, 6, 7, 1, 7, 7, 3, 3, 3, 3]


def test_predictions_are_computed_once_for_all_metrics(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", None, 1), (None, 1, 1), ("k", 1, None), ("k", 1, 1)], "k string, t int, p int")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    got = stats.class_counts(df.mapInArrow(count, "k string, t int, p int"), "t", "p", ["k"]).collect()
    assert read.value == 5
    assert sorted(((r.k, r.cls, r.support, r.predicted, r.tp) for r in got), key=str) == sorted(
        [("k", 0, 1, 0, 0), ("k", 1, 2, 3, 1), ("k", None, 1, 0, 0), ("k", None, 0, 1, 0), (None, 1, 1, 0, 0), (None, 1, 0, 1, 0)], key=str)


def test_a_class_that_is_alone_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.0, None, 1) for i in range(20)], "id long, a double, b double, y int")
    for train in (df, df.limit(0)):
        pred = classify.fit_predict(train, df, "forest", {"y": 2}, ["a", "b"], ["id"], {"n_estimators": 3}).select("pred_y").distinct().collect()
        assert [r.pred_y for r in pred] == [int(train is df)]
