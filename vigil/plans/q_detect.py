"""Detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import inv_norm_sql
from ..operators import detect, forest, shape
from ..operators.decompose import decompose
from ..session import cut_lineage
from .q_eval import IMPUTED_HOURLY_SQL, decompose_sql, imputed_hourly
from .registry import ORACLE, query
from .sqlbits2 import series_folds_sql

N_Q = 999
CAL_PART = (3, 5)  # training share of a series for the calibration table


# ---- item 59: time-of-day dynamic baseline over 4 walk-forward folds ----
@query("dynamic_baseline", sql=f"""
WITH s AS ({IMPUTED_HOURLY_SQL}),
f AS (SELECT sensor AS of, fold, greatest(start - 7 * s // 16, 0) AS train_lo, start AS test_lo, stop AS test_hi FROM ({series_folds_sql("SELECT * FROM s")})),
x AS (SELECT *, CAST(((epoch_us(ts) // 1000000) % 86400) // 3600 AS INTEGER) AS slot FROM s),
m AS (SELECT fold, sensor, slot, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n_train
      FROM x JOIN f ON sensor = of AND pos >= train_lo AND pos < test_lo GROUP BY fold, sensor, slot),
t AS (SELECT fold, sensor, ts, pos, v, slot FROM x JOIN f ON sensor = of AND pos >= test_lo AND pos < test_hi),
z AS (SELECT t.*, m.mean, m.std, m.n_train, round((v - m.mean) / nullif(m.std, 0), 6) AS z_raw
      FROM t LEFT JOIN m ON t.fold = m.fold AND t.sensor = m.sensor AND t.slot = m.slot)
SELECT fold, sensor, ts, pos, round(v, 6) AS value, round(mean, 6) AS mean, round(std, 6) AS std, n_train,
       CASE WHEN abs(z_raw) >= 3 THEN z_raw ELSE 0.0 END AS z FROM z""")
def q_dynamic_baseline(spark, d):
    x = imputed_hourly(spark, d)
    z = detect.dynamic_baseline(x, shape.series_folds(x, mode="baseline"))
    return z.withColumn("value", F.round("value", 6))


# ---- item 63: score -> z via the training quantile table, alarm threshold 3 ----
_PROBS = ", ".join(repr(k / (N_Q + 1)) for k in range(1, N_Q + 1))


@query("calibrate_scores", sql=f"""
WITH d0 AS (SELECT sensor, ts, pos, round(resid, 6) AS r FROM ({decompose_sql(24)}) WHERE resid IS NOT NULL),
d AS (SELECT d0.*, cut FROM d0 JOIN (SELECT sensor, (max(pos) + 1) * {CAL_PART[0]} // {CAL_PART[1]} AS cut FROM d0 GROUP BY sensor) USING (sensor)),
q AS (SELECT sensor, quantile_cont(r, [{_PROBS}]) AS qs FROM d WHERE pos < cut GROUP BY sensor),
t AS (SELECT d.sensor, d.ts, d.pos, d.r AS resid,
             (len(list_filter(list_transform(q.qs, lambda v: round(v, 6)), lambda v: v <= d.r)) + 0.5) / {N_Q + 1}.0 AS cdf
      FROM d JOIN q ON d.sensor = q.sensor WHERE d.pos >= cut),
z AS (SELECT *, round({inv_norm_sql('cdf')}, 6) AS z_raw FROM t)
SELECT sensor, ts, pos, resid, cdf, z_raw, CASE WHEN abs(z_raw) >= 3 THEN z_raw ELSE 0.0 END AS z FROM z""")
def q_calibrate_scores(spark, d):
    imp = imputed_hourly(spark, d)
    dec = (decompose(imp, 24).where(F.col("resid").isNotNull())
           .select("sensor", "ts", "pos", F.round("resid", 6).alias("resid")))
    cut = dec.groupBy("sensor").agg(F.floor((F.max("pos") + 1) * CAL_PART[0] / CAL_PART[1]).alias("_cut"))
    dec = dec.join(cut, "sensor")
    qt = detect.quantile_table(dec.where(F.col("pos") < F.col("_cut")), "sensor", "resid", N_Q)
    z = detect.calibrate(dec.where(F.col("pos") >= F.col("_cut")), qt, "sensor", "resid", N_Q)
    return z.select("sensor", "ts", "pos", "resid", "cdf", "z_raw", "z")


def _sliding(spark, d):
    x = imputed_hourly(spark, d)
    return shape.walk_forward(x, shape.series_folds(x, mode="sliding"))


# ---- item 62 (sizing): adaptive forest size per fold and sensor ----
@query("forest_size", sql=f"""
WITH s AS ({IMPUTED_HOURLY_SQL}),
f AS (SELECT sensor AS of, fold, greatest(start - 3 * s // 4, 0) AS lo, start - 1 AS hi FROM ({series_folds_sql("SELECT * FROM s")})),
tr AS (SELECT fold, sensor, v FROM s JOIN f ON sensor = of AND pos >= lo AND pos < hi),
st AS (SELECT fold, sensor, median(v) AS med, avg(v) AS mean, count(v) AS n FROM tr GROUP BY fold, sensor),
md AS (SELECT tr.fold, tr.sensor, avg(abs(v - mean)) AS mad FROM tr JOIN st ON tr.fold = st.fold AND tr.sensor = st.sensor
       GROUP BY tr.fold, tr.sensor),
b AS (SELECT st.fold, st.sensor, n, med - 3.0 * mad AS lo, med + 3.0 * mad AS hi FROM st JOIN md
      ON st.fold = md.fold AND st.sensor = md.sensor),
c AS (SELECT b.fold, b.sensor, b.n, sum(CASE WHEN v < b.lo THEN 1 ELSE 0 END) + sum(CASE WHEN v > b.hi THEN 1 ELSE 0 END) + 1 AS far0
      FROM tr JOIN b ON tr.fold = b.fold AND tr.sensor = b.sensor GROUP BY b.fold, b.sensor, b.n),
e AS (SELECT fold, sensor, n, greatest(CASE WHEN far0 < 10 THEN CAST(floor(n * 0.005) AS BIGINT) ELSE CAST(far0 AS BIGINT) END, 1) AS far FROM c),
g AS (SELECT *, n // far AS s0 FROM e)
SELECT fold, sensor, n, far, CAST(CASE WHEN s0 > n // 64 THEN 512 ELSE s0 END AS BIGINT) AS samples,
       CAST(CASE WHEN s0 >= n // 128 AND s0 <= n // 64 THEN n // s0 WHEN s0 > n // 64 THEN 64 ELSE 128 END AS BIGINT) AS trees
FROM g""")
def q_forest_size(spark, d):
    tr = _sliding(spark, d).where(F.col("role") == "train")
    return detect.forest_size(tr, ["fold", "sensor"])


_SIZE_SQL = ORACLE["forest_size"]
_MIX = "xor(({x}), ({x}) >> 16)"
_MIXED = _MIX.format(x=f"{_MIX.format(x='h0')} * 73244475 % 4294967296")
_MIXED = _MIX.format(x=f"({_MIXED}) * 73244475 % 4294967296")


# ---- item 62 (samples): the rows of every tree, drawn by arithmetic ----
@query("forest_samples", sql=f"""
WITH s AS ({IMPUTED_HOURLY_SQL}), size AS ({_SIZE_SQL}),
f AS (SELECT sensor AS of, fold, greatest(start - 3 * s // 4, 0) AS lo, start - 1 AS hi FROM ({series_folds_sql("SELECT * FROM s")})),
tr AS (SELECT fold, sensor, pos, v FROM s JOIN f ON sensor = of AND pos >= lo AND pos < hi),
sp AS (SELECT fold, sensor, min(pos) AS lo, max(pos) - min(pos) + 1 AS n_rows FROM tr GROUP BY 1, 2),
d AS (SELECT fold, sensor, samples, lo, n_rows, tree, unnest(range(least(samples, n_rows))) AS j
      FROM (SELECT fold, sensor, samples, lo, n_rows, unnest(range(trees)) AS tree FROM size JOIN sp USING (fold, sensor))),
h AS (SELECT *, (fold * 1000003 + tree * 65537 + j + 1) % 4294967296 AS h0 FROM d),
p AS (SELECT DISTINCT fold, sensor, tree, lo + CASE WHEN samples >= n_rows THEN j
             ELSE CAST(floor(({_MIXED}) * n_rows / 4294967296.0) AS BIGINT) END AS pos FROM h)
SELECT p.fold, p.sensor, p.tree, count(*) AS n, CAST(sum(p.pos) AS BIGINT) AS pos_sum, round(sum(v), 4) AS value_sum
FROM p JOIN tr ON p.fold = tr.fold AND p.sensor = tr.sensor AND p.pos = tr.pos WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
def q_forest_samples(spark, d):
    tr = _sliding(spark, d).where(F.col("role") == "train")
    rows = forest.forest_samples(tr, detect.forest_size(tr, ["fold", "sensor"]))
    return rows.groupBy("fold", "sensor", "tree").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"), F.round(F.sum("value"), 4).alias("value_sum"))


# ---- items 62, 63 (scores): forest per fold and sensor, calibrated to z ----
@query("forest_scores")
def q_forest_scores(spark, d):
    x = _sliding(spark, d)
    tr = x.where(F.col("role") == "train")
    return forest_z(x, detect.forest_size(tr, ["fold", "sensor"]))


def forest_z(x, sizes):
    """Test rows of every fold with forest score and z: the score's place among
    the training scores, as a normal quantile."""
    tr = x.where(F.col("role") == "train")
    steps = cut_lineage(forest.forest_steps(forest.forest_samples(tr, sizes)))  # read twice; two numbers for each leaf
    scored = cut_lineage(forest.forest_scores(x.select("fold", "sensor", "role", "ts", "pos", "value"), steps).withColumn("score", F.round("score", 9)))
    table = detect.quantile_table(scored.where("role = 'train'"), ["fold", "sensor"], "score", N_Q)
    z = detect.calibrate(scored.where("role = 'test'"), table, ["fold", "sensor"], "score", N_Q, digits=9)
    return z.select("fold", "sensor", "ts", "pos", "value", "score", "z")


# ---- item 60: additive forecaster, one split: fence on train residuals, metrics vs truth ----
@query("additive_forecast")
def q_additive_forecast(spark, d):
    from ..operators import forecast, stats
    from .domain import point_labels
    x = imputed_hourly(spark, d)
    pred = forecast.walk_forward_forecast(x, shape.series_folds(x, n_folds=1), 3600, daily=True)
    flagged = forecast.residual_fence(pred).join(point_labels(spark, d), "ts")
    m = stats.binary_metrics(flagged, "sensor", "label", "flag")
    err = stats.forecast_error(pred.where(F.col("role") == "test"), "sensor", "value", "yhat")
    return m.join(err, "sensor").select("sensor", "mse", "rmse", "precision", "recall", "f1")


# ---- item 61: walk-forward forecaster z-scores over the 4 sliding folds ----
@query("forecast_zscores")
def q_forecast_zscores(spark, d):
    from ..operators import forecast
    x = imputed_hourly(spark, d)
    pred = forecast.walk_forward_forecast(x, shape.series_folds(x, mode="sliding"), 3600, daily=True)
    z = forecast.residual_z(pred)
    return z.select("fold", "sensor", "ts", "pos", F.round("value", 6).alias("value"),
                    F.round("yhat", 6).alias("yhat"), "z")


# ---- items 1-3: write the scores as CSV partitioned by model, re-read with a schema ----
@query("sink_roundtrip", sql=f"""
WITH s AS ({IMPUTED_HOURLY_SQL}),
f AS (SELECT sensor AS of, fold, greatest(start - 7 * s // 16, 0) AS train_lo, start AS test_lo, stop AS test_hi FROM ({series_folds_sql("SELECT * FROM s")})),
x AS (SELECT *, CAST(((epoch_us(ts) // 1000000) % 86400) // 3600 AS INTEGER) AS slot FROM s),
m AS (SELECT fold, sensor, slot, avg(v) AS mean, stddev_samp(v) AS std
      FROM x JOIN f ON sensor = of AND pos >= train_lo AND pos < test_lo GROUP BY fold, sensor, slot),
t AS (SELECT fold, sensor, ts, v, slot FROM x JOIN f ON sensor = of AND pos >= test_lo AND pos < test_hi),
z AS (SELECT t.sensor, t.ts, round((v - m.mean) / nullif(m.std, 0), 6) AS z_raw
      FROM t LEFT JOIN m ON t.fold = m.fold AND t.sensor = m.sensor AND t.slot = m.slot)
SELECT 'DynamicBaseline' AS model, sensor, ts, CASE WHEN abs(z_raw) >= 3 THEN z_raw ELSE 0.0 END AS z FROM z""")
def q_sink_roundtrip(spark, d):
    from ..sources import sinks
    x = imputed_hourly(spark, d)
    z = detect.dynamic_baseline(x, shape.series_folds(x, mode="baseline"))
    path = sinks.result_path(spark, "scores")
    sinks.write_scores_csv(z.select(F.lit("DynamicBaseline").alias("model"), "sensor", "ts", "z"), path)
    return sinks.read_scores_csv(spark, path)
