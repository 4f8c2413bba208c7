"""Rows that share a class or a series key are not sent to one task for it."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import blocks
from vigil.operators import classify, cluster, features, stats


@pytest.fixture()
def no_automatic_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_class_codes_do_not_shuffle_the_rows(no_automatic_broadcast):
    spark = no_automatic_broadcast
    df = spark.createDataFrame([(i, "b" if i % 9 else "a") for i in range(40)] + [(40, None), (41, "c"), (41, "c")], "id long, kind string")
    got = features.label_encode(df, "kind")
    assert "SortMergeJoin" not in plan(got) and "ShuffledHashJoin" not in plan(got)
    # nulls sort first among the classes and get no code
    assert sorted((r.id, -1 if r.kind is None else r.kind) for r in got.collect()) == sorted(
        [(i, 2 if i % 9 else 1) for i in range(40)] + [(40, -1), (41, 3), (41, 3)])


def test_centroids_and_swaps_do_not_shuffle_the_series(no_automatic_broadcast):
    spark = no_automatic_broadcast
    s = spark.createDataFrame([("s", i, [0.0, float(i % 5 > 0)]) for i in range(30)], "sensor string, chunk_id int, vals array<double>")
    a = cluster.assign(s, cluster.seed_centroids(s, "sensor", 2), "sensor")
    train, test, _ = cluster.canonical_labels(a.where("chunk_id < 15"), a.where("chunk_id >= 15"), "sensor")
    d = cluster.dtw_assign(s, cluster.seed_centroids(s, "sensor", 2), "sensor")
    for df in (a, train, test, d):
        assert "SortMergeJoin" not in plan(df) and "ShuffledHashJoin" not in plan(df)
    # cluster 0 holds a fifth of the test series, so the labels swap
    assert {(r.chunk_id % 5 > 0, r.cluster) for r in train.unionByName(test).collect()} == {(True, 0), (False, 1)}


def test_blocks_have_a_partition_for_so_many_rows(spark, monkeypatch):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    monkeypatch.setattr(blocks, "PART_ROWS", 90)
    got = blocks.blocks(df, ["x"], ["y"], ["id"])
    assert got.rdd.getNumPartitions() == 12
    assert sum(len(r.key) // 8 for r in got.collect()) == 1000


def test_trials_of_a_forest_share_one_table(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 ((F.col("id") % 20 > 9) != (F.col("id") % 7 > 3)).cast("int").alias("y")).repartition(3, "id").persist()
    made, real = [], classify.assembled
    monkeypatch.setattr(classify, "assembled", lambda *a: made.append(1) or real(*a))
    found = classify.search(df, "forest", "y", {"y": 2}, ["a", "b"], ["id"], n_random=2, n_guided=1, fixed={"n_estimators": 3}, parallelism=2)
    assert len(made) == 1
    for t in found:  # each trial is worth what a fit of its own gives
        pred = classify.fit_predict(df, df, "forest", {"y": 2}, ["a", "b"], ["id"], classify.model_params("forest", t["params"]) | {"n_estimators": 3})
        assert pred.columns == [*df.columns, "pred_y"]
        assert t["value"] == pytest.approx(float(stats.multiclass_metrics(pred, "y", "pred_y").first()["balanced_accuracy"]))


def test_a_kept_partition_holds_about_as_many_rows_as_a_block_partition(spark, monkeypatch):
    """Files of densely packed rows make few partitions of many rows each."""
    d = spark.createDataFrame([(i, None if i % 3 else i % 7) for i in range(5000)] * 2, "k long, v int").coalesce(1)
    assert blocks.bounded(d).rdd.getNumPartitions() == 1  # few rows stay as they are
    monkeypatch.setattr(blocks, "PART_ROWS", 500)
    got = blocks.bounded(d)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 800
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
