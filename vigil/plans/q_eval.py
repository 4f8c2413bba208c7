"""Decomposition, fences, metrics and evaluation queries
(SURVEY §2.4-2.6, §2.9: items 34-37, 44-54, 69, 70, S4 batch twin)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.time import epoch_us, from_epoch_us
from ..operators import evaluate, grid, shape, stats
from ..operators.decompose import decompose, decompose_many
from ..session import cut_lineage
from .domain import SCORED_EVENTS_SQL, point_labels, readings, scored_events
from .q_features import features
from .registry import query
from .sqlbits import binned_grid
from .sqlbits2 import FEATURES_SQL, POINT_LABELS_SQL

PERIODS = [24, 12, 8, 6]   # hourly analogue of the reference's [1440, 720, 480, 360]


def imputed_hourly(spark, d):
    return shape.impute(readings(spark, d), "1 hour", limit=60)


IMPUTED_HOURLY_SQL = f"""
  WITH g AS ({binned_grid(3600)}),
  f AS (SELECT sensor, ts, pos, last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
        ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS v FROM g),
  m AS (SELECT sensor, median(v) AS med FROM f GROUP BY sensor)
  SELECT f.sensor, f.ts, f.pos, coalesce(f.v, m.med) AS v FROM f JOIN m ON f.sensor = m.sensor"""


def decompose_sql(p: int) -> str:
    trend = (f"(sum(v) OVER (PARTITION BY sensor ORDER BY pos ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"
             f" - 0.5 * v - 0.5 * lag(v, {p}) OVER (PARTITION BY sensor ORDER BY pos)) / {p}")
    return f"""
  WITH s AS ({IMPUTED_HOURLY_SQL}),
  t AS (SELECT sensor, ts, pos, v, CASE WHEN pos >= {p} THEN {trend} END AS trend FROM s),
  ph AS (SELECT sensor, pos % {p} AS phase, avg(v - trend) AS a FROM t WHERE trend IS NOT NULL GROUP BY sensor, pos % {p}),
  ph2 AS (SELECT sensor, phase, a - avg(a) OVER (PARTITION BY sensor) AS seasonal FROM ph)
  SELECT t.sensor, t.ts, t.pos, t.v, t.trend, ph2.seasonal, t.v - t.trend - ph2.seasonal AS resid
  FROM t LEFT JOIN ph2 ON t.sensor = ph2.sensor AND t.pos % {p} = ph2.phase"""


def fence_sql(p: int) -> str:
    """Decomposition residuals (non-null, rounded) with inclusive IQR fences."""
    return f"""
  WITH d AS (SELECT sensor, ts, pos, round(resid, 6) AS r FROM ({decompose_sql(p)}) WHERE resid IS NOT NULL),
  q AS (SELECT sensor, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.75), 6) AS q3 FROM d GROUP BY sensor),
  b AS (SELECT sensor, round(q1 - 3.0 * (q3 - q1), 6) AS lower, round(q3 + 3.0 * (q3 - q1), 6) AS upper FROM q)
  SELECT d.sensor, d.ts, d.pos, d.r AS resid, CASE WHEN d.r <= b.lower OR d.r >= b.upper THEN 1 ELSE 0 END AS flag
  FROM d JOIN b ON d.sensor = b.sensor"""


def _fence(spark, d, p, imp=None):
    imp = imp if imp is not None else imputed_hourly(spark, d)
    dec = decompose(imp, p).where(F.col("resid").isNotNull()).withColumn("resid", F.round("resid", 6))
    b = stats.iqr_bounds(dec, "sensor", "resid", 3.0, 6)
    return (dec.join(b.select("sensor", "lower", "upper"), "sensor")
               .withColumn("flag", stats.iqr_flag(F.col("resid"), F.col("lower"), F.col("upper"))))


# ---- item 53: one-sided additive decomposition, p = 24 ----
@query("decompose", sql=f"""
SELECT sensor, ts, pos, round(v, 8) AS value, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal,
       round(resid, 8) AS resid FROM ({decompose_sql(24)})""")
def q_decompose(spark, d):
    x = decompose(imputed_hourly(spark, d), 24)
    # trend values are exact decimals of up to 7 places (sums of half-cents / 24):
    # rounding at 8 places cannot meet a tie, so both engines agree
    return x.select("sensor", "ts", "pos", *[F.round(c, 8).alias(c) for c in ("value", "trend", "seasonal", "resid")])


# ---- item 44: IQR fence on the residuals ----
@query("iqr_fence", sql=f"SELECT * FROM ({fence_sql(24)})")
def q_iqr_fence(spark, d):
    return _fence(spark, d, 24).select("sensor", "ts", "pos", "resid", "flag")


# ---- items 54, 56: cycle-length search, best precision per sensor (first period on ties) ----
def _cycle_sql():
    parts = []
    for i, p in enumerate(PERIODS):
        parts.append(f"""SELECT f.sensor, {p} AS period, {i} AS ord,
            sum(CASE WHEN l.label = 1 AND f.flag = 1 THEN 1 ELSE 0 END) AS tp,
            sum(CASE WHEN l.label <> 1 AND f.flag = 1 THEN 1 ELSE 0 END) AS fp,
            sum(CASE WHEN l.label = 1 AND f.flag <> 1 THEN 1 ELSE 0 END) AS fn
          FROM ({fence_sql(p)}) f JOIN ({POINT_LABELS_SQL}) l ON f.ts = l.ts GROUP BY f.sensor""")
    return f"""
WITH c AS ({" UNION ALL ".join(parts)}),
m AS (SELECT sensor, period, ord,
        coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY precision DESC, ord) AS rn FROM m)
SELECT sensor, period, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM r WHERE rn = 1"""


@query("cycle_search", sql=_cycle_sql())
def q_cycle_search(spark, d):
    dec = decompose_many(imputed_hourly(spark, d), PERIODS).withColumn("resid", F.round("resid", 6))
    dec = cut_lineage(dec)  # the fences and the flags read it
    keys = ["sensor", "period"]
    b = stats.iqr_bounds(dec, keys, "resid", 3.0, 6)
    flagged = (dec.join(b.select(*keys, "lower", "upper"), keys)
                  .withColumn("flag", stats.iqr_flag(F.col("resid"), F.col("lower"), F.col("upper")))
                  .join(point_labels(spark, d), "ts"))
    m = stats.binary_metrics(flagged, keys, "label", "flag", digits=None)
    w = Window.partitionBy("sensor").orderBy(F.col("precision").desc(), F.array_position(F.array(*map(F.lit, PERIODS)), F.col("period")))
    best = m.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select("sensor", "period", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# ---- item 45 (+52): binary precision / recall / F1 per sensor ----
@query("binary_metrics", sql=f"""
WITH e AS ({SCORED_EVENTS_SQL}),
c AS (SELECT sensor, sum(CASE WHEN label = 1 AND alarm = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label <> 1 AND alarm = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND alarm <> 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n_true, sum(CASE WHEN alarm = 1 THEN 1 ELSE 0 END) AS n_pred
      FROM e GROUP BY sensor)
SELECT sensor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(n_true AS BIGINT) AS n_true, CAST(n_pred AS BIGINT) AS n_pred,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c""")
def q_binary_metrics(spark, d):
    return stats.binary_metrics(scored_events(spark, d), "sensor", "label", "alarm")


# ---- item 46: adjusted Rand index of alarm vs truth partitions per sensor ----
@query("ari", sql=f"""
WITH e AS ({SCORED_EVENTS_SQL}),
c AS (SELECT sensor, label, alarm, count(*) AS nij FROM e GROUP BY ALL),
a AS (SELECT sensor, sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sensor, label, sum(nij) AS ai FROM c GROUP BY ALL) GROUP BY sensor),
b AS (SELECT sensor, sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sensor, alarm, sum(nij) AS bj FROM c GROUP BY ALL) GROUP BY sensor),
s AS (SELECT sensor, sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c GROUP BY sensor),
x AS (SELECT s.sensor, n, sij, sa, sb, sa * sb / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2 AS mx
      FROM s JOIN a ON s.sensor = a.sensor JOIN b ON s.sensor = b.sensor)
SELECT sensor, CAST(n AS BIGINT) AS n, round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) AS ari FROM x""")
def q_ari(spark, d):
    return stats.adjusted_rand_index(scored_events(spark, d), "sensor", "label", "alarm")


# ---- machine truth vs a simplified rule predictor (items 47, 48) ----
def _pred_sql():
    return f"""
  SELECT failure_type AS actual,
         CASE WHEN heat < 8.6 AND rpm < 1400 THEN 0 WHEN power < 3600 OR power > 8800 THEN 3 ELSE 1 END AS predicted
  FROM ({FEATURES_SQL})"""


def _pred(spark, d):
    f = features(spark, d)
    pred = (F.when((F.col("heat") < 8.6) & (F.col("rpm") < 1400), 0)
             .when((F.col("power") < 3600) | (F.col("power") > 8800), 3).otherwise(1))
    return f.select(F.col("failure_type").alias("actual"), pred.alias("predicted"))


@query("multiclass_metrics", sql=f"""
WITH p AS ({_pred_sql()}),
pairs AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT actual AS cls, sum(n) AS support FROM pairs GROUP BY actual),
q AS (SELECT predicted AS cls, sum(n) AS npred FROM pairs GROUP BY predicted),
k AS (SELECT coalesce(t.cls, q.cls) AS cls, coalesce(support, 0) AS support, coalesce(npred, 0) AS npred
      FROM t FULL JOIN q ON t.cls = q.cls),
c AS (SELECT k.cls, support, npred, coalesce(tp.n, 0) AS tp FROM k LEFT JOIN
      (SELECT actual AS cls, n FROM pairs WHERE actual = predicted) tp ON k.cls = tp.cls),
m AS (SELECT *, npred - tp AS fp, support - tp AS fn FROM c),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r,
             coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f FROM m),
g AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
             avg(CASE WHEN support > 0 THEN r END) AS ba FROM r)
SELECT round_even(coalesce(tp / nullif(tp + fp, 0), 0.0) * 100, 2) AS micro_precision,
       round_even(coalesce(tp / nullif(tp + fn, 0), 0.0) * 100, 2) AS micro_recall,
       round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) * 100, 2) AS micro_f1,
       round_even(mp * 100, 2) AS macro_precision, round_even(mr * 100, 2) AS macro_recall,
       round_even(mf * 100, 2) AS macro_f1, round_even(ba * 100, 2) AS balanced_accuracy FROM g""")
def q_multiclass_metrics(spark, d):
    return stats.multiclass_metrics(_pred(spark, d), "actual", "predicted")


@query("confusion", sql=f"""
WITH p AS ({_pred_sql()}),
l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p),
pairs AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL)
SELECT a.label AS actual, b.label AS predicted, CAST(coalesce(pairs.n, 0) AS BIGINT) AS n
FROM l a, l b LEFT JOIN pairs ON pairs.actual = a.label AND pairs.predicted = b.label""")
def q_confusion(spark, d):
    return stats.confusion(_pred(spark, d), "actual", "predicted")


# ---- item 49: false-alarm percentage of a z-score table per sensor ----
@query("false_alarm_pct", sql="""
WITH s AS (SELECT event_type AS sensor, avg(value) AS mu, stddev_samp(value) AS sd FROM events GROUP BY ALL),
z AS (SELECT e.event_type AS sensor, round((e.value - s.mu) / s.sd, 6) AS z FROM events e JOIN s ON e.event_type = s.sensor),
z2 AS (SELECT sensor, CASE WHEN abs(z) >= 3 THEN z ELSE 0.0 END AS z FROM z)
SELECT sensor, count(*) AS n,
       round(avg(CASE WHEN z IS NULL OR z <> 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS false_alarm_pct
FROM z2 GROUP BY sensor""")
def q_false_alarm_pct(spark, d):
    r = readings(spark, d)
    s = r.groupBy("sensor").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    z = r.join(s, "sensor").withColumn("z", F.round((F.col("value") - F.col("mu")) / F.col("sd"), 6))
    z = z.withColumn("z", F.when(F.abs("z") >= 3, F.col("z")).otherwise(F.lit(0.0)))
    return stats.false_alarm_pct(z, "sensor", "z")


# ---- item 50: median +- 3 * mean absolute deviation, counts outside ----
@query("mad_bounds", sql="""
WITH s AS (SELECT event_type AS sensor, median(value) AS median, avg(value) AS mean, count(value) AS n FROM events GROUP BY ALL),
dv AS (SELECT s.sensor, avg(abs(e.value - s.mean)) AS spread FROM events e JOIN s ON e.event_type = s.sensor GROUP BY s.sensor),
b AS (SELECT s.sensor, s.median, dv.spread, s.n, round(s.median - 3.0 * dv.spread, 6) AS lower,
             round(s.median + 3.0 * dv.spread, 6) AS upper FROM s JOIN dv ON s.sensor = dv.sensor),
c AS (SELECT b.sensor, sum(CASE WHEN round(e.value, 6) < b.lower THEN 1 ELSE 0 END) AS n_low,
             sum(CASE WHEN round(e.value, 6) > b.upper THEN 1 ELSE 0 END) AS n_high
      FROM events e JOIN b ON e.event_type = b.sensor GROUP BY b.sensor)
SELECT b.sensor, round(b.median, 6) AS median, round(b.spread, 6) AS spread, b.lower, b.upper,
       CAST(c.n_low AS BIGINT) AS n_low, CAST(c.n_high AS BIGINT) AS n_high, b.n
FROM b JOIN c ON b.sensor = c.sensor""")
def q_mad_bounds(spark, d):
    return stats.mad_bounds(readings(spark, d), "sensor", "value", 3.0, "mean")


# ---- item 34: forecast (same hour a day earlier) vs actual, aligned on ts ----
RESID_SQL = f"""
  WITH g AS ({binned_grid(3600)})
  SELECT a.sensor, a.ts, a.v AS actual, f.v AS forecast, a.v - f.v AS residual
  FROM g a LEFT JOIN g f ON a.sensor = f.sensor AND a.ts = f.ts + INTERVAL 24 HOUR"""


def _residuals(spark, d):
    g = grid.resample(readings(spark, d), "1 hour", "median").select("sensor", "ts", "value")
    fc = g.select("sensor", from_epoch_us(epoch_us("ts") + F.lit(86400 * 10**6)).alias("ts"),
                  F.col("value").alias("forecast"))
    return (g.join(fc, ["sensor", "ts"], "left")
             .select("sensor", "ts", F.col("value").alias("actual"), "forecast",
                     (F.col("value") - F.col("forecast")).alias("residual")))


@query("residuals", sql=f"""
SELECT sensor, ts, round(actual, 6) AS actual, round(forecast, 6) AS forecast, round(residual, 6) AS residual
FROM ({RESID_SQL})""")
def q_residuals(spark, d):
    r = _residuals(spark, d)
    return r.select("sensor", "ts", *[F.round(c, 6).alias(c) for c in ("actual", "forecast", "residual")])


# ---- item 51: mean squared error (and its root) of the forecast ----
@query("forecast_error", sql=f"""
SELECT sensor, count(power(actual - forecast, 2)) AS n, round(avg(power(actual - forecast, 2)), 6) AS mse,
       round(sqrt(avg(power(actual - forecast, 2))), 6) AS rmse FROM ({RESID_SQL}) GROUP BY sensor""")
def q_forecast_error(spark, d):
    return stats.forecast_error(_residuals(spark, d), "sensor", "actual", "forecast")


# ---- islands of truth on scored events (shared by 36, 37, 69, 70) ----
SEG_SQL = f"""
  WITH e AS ({SCORED_EVENTS_SQL}),
  x AS (SELECT *, lag(label) OVER (PARTITION BY sensor ORDER BY ts) AS prev FROM e),
  y AS (SELECT *, CAST(sum(CASE WHEN label = 1 AND (prev IS NULL OR prev <> 1) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_no FROM x)
  SELECT * FROM y"""
SEGMENTS_SQL = f"""
  SELECT sensor, seg_no, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_points
  FROM ({SEG_SQL}) WHERE label = 1 GROUP BY sensor, seg_no"""
ALARMS_SQL = f"SELECT sensor, ts FROM ({SCORED_EVENTS_SQL}) WHERE alarm = 1"
MATCH_COND = ("a.sensor = s.sensor AND a.ts >= s.seg_start - INTERVAL 600 SECOND AND a.ts <= s.seg_end")


def _alarms_and_segments(spark, d):
    e = scored_events(spark, d)
    return e.where(F.col("alarm") == 1).select("sensor", "ts"), evaluate.segments(e, "sensor")


@query("early_alarms", sql=f"""
SELECT a.sensor, a.ts, s.seg_no, s.seg_start, s.seg_end FROM ({ALARMS_SQL}) a JOIN ({SEGMENTS_SQL}) s ON {MATCH_COND}""")
def q_early_alarms(spark, d):
    a, s = _alarms_and_segments(spark, d)
    return evaluate.early_alarms(a, s, "sensor", 600)


@query("false_alarms", sql=f"""
SELECT a.sensor, a.ts FROM ({ALARMS_SQL}) a WHERE NOT EXISTS (SELECT 1 FROM ({SEGMENTS_SQL}) s WHERE {MATCH_COND})""")
def q_false_alarms(spark, d):
    a, s = _alarms_and_segments(spark, d)
    return evaluate.false_alarms(a, s, "sensor", 600)


PA_SQL = f"""
  WITH y AS ({SEG_SQL}),
  seg AS (SELECT sensor, seg_no, min(ts) AS s0, count(*) AS n, max(alarm) AS hit,
                 min(CASE WHEN alarm = 1 THEN ts END) AS first_alarm FROM y WHERE label = 1 GROUP BY sensor, seg_no),
  sa AS (SELECT sensor, sum(CASE WHEN hit = 1 THEN n ELSE 0 END) AS tp, sum(CASE WHEN hit = 1 THEN 0 ELSE n END) AS fn,
                sum(CASE WHEN hit = 1 THEN 1 ELSE 0 END) AS n_detected, count(*) AS n_segments,
                avg(CASE WHEN hit = 1 THEN (epoch_us(first_alarm) - epoch_us(s0)) / 1000000.0 END) AS mttd_s
         FROM seg GROUP BY sensor),
  fp AS (SELECT sensor, sum(CASE WHEN alarm = 1 AND label <> 1 THEN 1 ELSE 0 END) AS fp FROM y GROUP BY sensor),
  j AS (SELECT fp.sensor, coalesce(tp, 0) AS tp, fp, coalesce(fn, 0) AS fn, coalesce(n_segments, 0) AS n_segments,
               coalesce(n_detected, 0) AS n_detected, mttd_s FROM fp LEFT JOIN sa ON fp.sensor = sa.sensor)
  SELECT sensor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
         CAST(n_segments AS BIGINT) AS n_segments, CAST(n_detected AS BIGINT) AS n_detected,
         round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
         round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(mttd_s, 6) AS mttd_s FROM j"""


@query("point_adjusted", sql=PA_SQL)
def q_point_adjusted(spark, d):
    return evaluate.point_adjusted(scored_events(spark, d), "sensor")


@query("mttd", sql=f"SELECT sensor, n_detected, mttd_s FROM ({PA_SQL})")
def q_mttd(spark, d):
    return evaluate.point_adjusted(scored_events(spark, d), "sensor").select("sensor", "n_detected", "mttd_s")


@query("revised_point_adjusted", sql=f"""
WITH s AS ({SEGMENTS_SQL}), a AS ({ALARMS_SQL}),
hits AS (SELECT s.sensor, s.seg_no, min(CASE WHEN a.ts >= s.seg_start THEN a.ts END) AS first_alarm
         FROM a JOIN s ON {MATCH_COND} GROUP BY s.sensor, s.seg_no),
per AS (SELECT s.sensor, s.seg_no, s.seg_start, h.seg_no IS NOT NULL AS hit, h.first_alarm
        FROM s LEFT JOIN hits h ON s.sensor = h.sensor AND s.seg_no = h.seg_no),
sa AS (SELECT sensor, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN hit THEN 0 ELSE 1 END) AS fn,
              count(*) AS n_segments, avg((epoch_us(first_alarm) - epoch_us(seg_start)) / 1000000.0) AS mttd_s
       FROM per GROUP BY sensor),
fa AS (SELECT a.sensor, count(*) AS fp FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE {MATCH_COND}) GROUP BY a.sensor),
base AS (SELECT DISTINCT event_type AS sensor FROM events),
j AS (SELECT base.sensor, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
             coalesce(n_segments, 0) AS n_segments, mttd_s
      FROM base LEFT JOIN sa ON base.sensor = sa.sensor LEFT JOIN fa ON base.sensor = fa.sensor)
SELECT sensor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(n_segments AS BIGINT) AS n_segments,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(mttd_s, 6) AS mttd_s FROM j""")
def q_revised_point_adjusted(spark, d):
    return evaluate.revised_point_adjusted(scored_events(spark, d), "sensor", early_s=600)


# ---- S4 batch twin: alarm episodes closed by a 10-minute gap ----
@query("alarm_episodes", sql=f"""
WITH a AS ({ALARMS_SQL}),
x AS (SELECT *, lag(ts) OVER (PARTITION BY sensor ORDER BY ts) AS prev FROM a),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 10 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM x)
SELECT sensor, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n_alarms FROM y GROUP BY sensor, ep""")
def q_alarm_episodes(spark, d):
    a = scored_events(spark, d).where(F.col("alarm") == 1).select("sensor", "ts")
    return evaluate.alarm_episodes(a, "sensor", "10 minutes")


# ---- flagship: impute -> decompose -> IQR fence -> point-adjusted vs point labels ----
@query("flagship")
def q_flagship(spark, d):
    f = _fence(spark, d, 24).join(point_labels(spark, d), "ts")
    return evaluate.point_adjusted(f.withColumnRenamed("flag", "alarm"), "sensor")
