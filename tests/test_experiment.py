"""The experiment over all models on a small grid with planted anomalies."""

import numpy as np
from pyspark.sql import functions as F

from vigil.plans import q_experiment as q


def grid(spark):
    rng = np.random.default_rng(0)
    rows = [(s, p, float(5 * np.sin(p * 2 * np.pi / 24) + rng.normal())) for s in "uv" for p in range(960)]
    spots = {("u", 700), ("u", 701), ("v", 930)}
    rows = [(s, p, v + 60 if (s, p) in spots else v) for s, p, v in rows]
    df = spark.createDataFrame(rows, "sensor string, pos long, value double")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("pos") * 3600).cast("timestamp_ntz")).persist(), spots


def test_all_models_score_the_same_readings_and_find_the_planted_ones(spark):
    x, spots = grid(spark)
    scores = q.model_scores(x).persist()
    n = {r.model: (r.n, r.d) for r in scores.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("sensor", "ts").alias("d")).collect()}
    assert set(n) == {"DynamicBaseline", "RandomCutForest", "AdditiveForecast"} and set(n.values()) == {(2 * (960 - 512), 2 * (960 - 512))}
    hit = {(r.model, r.sensor, r.pos) for r in scores.join(x.select("sensor", "ts", "pos"), ["sensor", "ts"]).where("z <> 0").collect()}
    for model in ("DynamicBaseline", "AdditiveForecast"):
        assert {(model, s, p) for s, p in spots} <= hit

    labels = x.select("ts", "pos").distinct().select("ts", F.col("pos").isin([p for _, p in spots]).cast("int").alias("label"))
    got = {(r.model, r.sensor, r.scenario): r for r in q.scenario_metrics(scores, labels).collect()}
    days = range(1, 4)  # 448 test hours from position 512 on
    assert {(s, k) for _, s, k in got} == {(s, k) for s in "uv" for k in days} and len(got) == 18
    two = got["DynamicBaseline", "u", 2]  # position 700 lies in the second week
    assert (two.n_segments, two.n_detected, two.tp, two.fn, two.mttd_s) == (1, 1, 2, 0, 0.0)
    assert all(0 <= r.false_alarm_pct < 50 for r in got.values())
