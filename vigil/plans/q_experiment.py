"""The experiment over all models: z-scores of three detectors on the same
walk-forward folds, evaluated point-adjusted by model, sensor and scenario of
seven days (SURVEY §2.9: items 32, 49, 59-63, 69)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, evaluate, forecast, shape, stats
from ..session import cut_lineage
from .domain import SCORED_EVENTS_SQL, point_labels
from .q_detect import forest_z
from .q_eval import PA_SQL, imputed_hourly
from .registry import ORACLE, query
from .sqlbits2 import POINT_LABELS_SQL


def model_scores(x):
    """(model, sensor, ts, z) of every detector on the imputed grid ``x``: the
    test part of each fold once, without the sliding folds' leading row."""
    sliding, keys = shape.series_folds(x, mode="sliding"), ["sensor", "fold"]
    begins = sliding.where("role = 'test'").select(*keys, "lo")
    rows = cut_lineage(shape.walk_forward(x, sliding))  # both window models read it
    train = rows.where("role = 'train'")
    forest = forest_z(rows, detect.forest_size(train, ["fold", "sensor"]))
    trend = forecast.residual_z(forecast.walk_forward_forecast(x, sliding, 3600, daily=True))
    out = detect.dynamic_baseline(x, shape.series_folds(x, mode="baseline")).select(F.lit("DynamicBaseline").alias("model"), "sensor", "ts", "z")
    for name, z in (("RandomCutForest", forest), ("AdditiveForecast", trend)):
        z = z.join(begins, keys).where(F.col("pos") > F.col("lo"))
        out = out.unionByName(z.select(F.lit(name).alias("model"), "sensor", "ts", "z"))
    return out


def scenario_metrics(scores, labels, days: int = 7):
    """Point-adjusted metrics and the share of false alarms of every model,
    sensor and scenario; scenarios count from the first scored day. A missing
    z is no alarm, but counts as one in the false-alarm share, as NaN does in
    the reference."""
    t0 = scores.agg(F.min("ts").alias("_t0")).withColumn("_k", F.lit(0))  # one row
    x = shape.scenario(scores.withColumn("_k", F.lit(0)).join(F.broadcast(t0), "_k"), "_t0", days=days).drop("_t0", "_k")
    x = cut_lineage(x.join(labels, "ts").withColumn("alarm", F.coalesce(F.col("z") != 0, F.lit(False)).cast("int")))
    keys = ["model", "sensor", "scenario"]
    wrong = stats.false_alarm_pct(x.where("label <> 1"), keys, "z").withColumnRenamed("n", "n_normal")
    return evaluate.point_adjusted(x, keys, materialize=False).join(wrong, keys, "left")


@query("model_scores")
def q_model_scores(spark, d):
    return model_scores(imputed_hourly(spark, d))


@query("scenario_evaluation")
def q_scenario_evaluation(spark, d):
    scores = cut_lineage(model_scores(imputed_hourly(spark, d)))
    return scenario_metrics(scores, point_labels(spark, d))


# ---- the same evaluation of the one model that SQL can express ----
_SRC = f"""
  SELECT z.sensor || '|' || CAST(date_diff('day', CAST(t0 AS DATE), CAST(z.ts AS DATE)) // 7 + 1 AS VARCHAR) AS sensor, z.ts, z.value,
         l.label, CASE WHEN coalesce(z.z, 0) <> 0 THEN 1 ELSE 0 END AS alarm
  FROM ({ORACLE["dynamic_baseline"]}) z JOIN ({POINT_LABELS_SQL}) l ON z.ts = l.ts,
       (SELECT min(ts) AS t0 FROM ({ORACLE["dynamic_baseline"]}))"""


@query("baseline_scenarios", sql=f"""
SELECT split_part(sensor, '|', 1) AS sensor, CAST(split_part(sensor, '|', 2) AS INTEGER) AS scenario, * EXCLUDE (sensor)
FROM ({PA_SQL.replace(SCORED_EVENTS_SQL, _SRC)})""")
def q_baseline_scenarios(spark, d):
    x = imputed_hourly(spark, d)
    z = detect.dynamic_baseline(x, shape.series_folds(x, mode="baseline"))
    return scenario_metrics(z.select(F.lit("DynamicBaseline").alias("model"), "sensor", "ts", "z"), point_labels(spark, d)).drop("model", "n_normal", "false_alarm_pct")
