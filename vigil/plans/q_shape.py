"""Queries for shaping, cycles and relational rules
(SURVEY §2.2-2.3: items 9, 11, 12, 14, 16, 24-33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, relational, shape
from ..sources.tables import load
from .domain import point_labels, readings
from .registry import query
from .sqlbits import binned_grid
from .sqlbits2 import POINT_LABELS_SQL, series_folds_sql

#: The sensors of the given tables, for the SQL; the query takes them from the data.
SENSORS = ["click", "error", "purchase", "signup", "view"]
DAY_US = 86400 * 10**6
HALF_US = 43200 * 10**6


def hourly(spark, d):
    return grid.resample(readings(spark, d), "1 hour", "median")


def hourly_filled(spark, d):
    return grid.fill_previous(hourly(spark, d))


HOURLY_FILLED_SQL = f"""
  SELECT sensor, ts, pos, last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM ({binned_grid(3600)})"""


# ---- item 24: imputation pipeline on the 1-minute grid ----
@query("impute", sql=f"""
WITH g AS ({binned_grid(60)}),
c AS (SELECT sensor, ts, pos, CASE WHEN sensor IN ('error') THEN coalesce(v, 0.0) ELSE v END AS v
      FROM g WHERE sensor <> 'signup'),
f AS (SELECT sensor, ts, pos, last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
      ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS v FROM c),
m AS (SELECT sensor, median(v) AS med FROM f GROUP BY sensor)
SELECT f.sensor, f.ts, f.pos, round(coalesce(f.v, m.med), 6) AS value FROM f JOIN m ON f.sensor = m.sensor""")
def q_impute(spark, d):
    x = shape.impute(readings(spark, d), "1 minute", drop=["signup"], zero_fill=["error"], limit=60)
    return x.withColumn("value", F.round("value", 6))


# ---- item 25: daily chunks (24 hourly values), incomplete tail dropped ----
@query("chunk_series", sql=f"""
WITH g AS ({HOURLY_FILLED_SQL}),
c AS (SELECT sensor, pos // 24 AS chunk_id, min(ts) AS start_ts, count(*) AS n,
             list(round(v, 6) ORDER BY pos) AS vals FROM g GROUP BY sensor, pos // 24)
SELECT sensor, chunk_id, start_ts, vals FROM c WHERE n = 24""")
def q_chunk_series(spark, d):
    g = hourly_filled(spark, d).withColumn("value", F.round("value", 6))
    return shape.chunk_series(g, 24)


# ---- item 26: chronological split, first floor(frac*N) rows are train ----
FRAC = 131040 / 220320


@query("chrono_split", sql=f"""
WITH g AS ({binned_grid(3600)}), n AS (SELECT sensor, count(*) AS n FROM g GROUP BY sensor)
SELECT g.sensor, g.ts, g.pos, CASE WHEN g.pos < floor({FRAC!r} * n.n) THEN 'train' ELSE 'test' END AS split
FROM g JOIN n ON g.sensor = n.sensor""")
def q_chrono_split(spark, d):
    return shape.chrono_split(hourly(spark, d), FRAC).select("sensor", "ts", "pos", "split")


# ---- item 27: walk-forward folds, expanding and sliding ----
@query("walk_forward", sql=f"""
WITH g AS ({binned_grid(3600)}), b AS ({series_folds_sql("SELECT * FROM g")}),
f AS (
  SELECT 'expanding' AS mode, sensor, fold, 'train' AS role, 0 AS lo, start AS hi FROM b
  UNION ALL SELECT 'expanding', sensor, fold, 'test', start, stop FROM b
  UNION ALL SELECT 'sliding', sensor, fold, 'train', greatest(start - 3 * s // 4, 0), start - 1 FROM b
  UNION ALL SELECT 'sliding', sensor, fold, 'test', start - 1, stop FROM b)
SELECT f.mode, f.fold, f.role, g.sensor, g.pos, g.ts FROM g JOIN f ON g.sensor = f.sensor AND g.pos >= f.lo AND g.pos < f.hi""")
def q_walk_forward(spark, d):
    g = hourly(spark, d).select("sensor", "pos", "ts")
    modes = [shape.series_folds(g, mode=m).withColumn("mode", F.lit(m)) for m in ("expanding", "sliding")]
    return shape.walk_forward(g, modes[0].unionByName(modes[1])).select("mode", "fold", "role", "sensor", "pos", "ts")


# ---- item 32: scenarios of 7 days from the first day ----
@query("scenario", sql="""
WITH t AS (SELECT min(ts) AS t0 FROM events)
SELECT event_id, ts, CAST(date_diff('day', CAST(t0 AS DATE), CAST(ts AS DATE)) // 7 + 1 AS INTEGER) AS scenario
FROM events, t""")
def q_scenario(spark, d):
    e = load(spark, d, "events").select("event_id", "ts")
    t0 = e.agg(F.min("ts").alias("t0")).withColumn("_k", F.lit(0))
    x = e.withColumn("_k", F.lit(0)).join(F.broadcast(t0), "_k")
    return shape.scenario(x, "t0").select("event_id", "ts", "scenario")


# ---- item 33 (+35): long -> wide with the shared label joined by ts ----
@query("pivot_scores", sql=f"""
WITH g AS ({binned_grid(3600)}), l AS ({POINT_LABELS_SQL}),
w AS (SELECT ts, {", ".join(f"round(max(CASE WHEN sensor = '{s}' THEN v END), 6) AS {s}" for s in SENSORS)}
      FROM g GROUP BY ts)
SELECT w.*, l.label FROM w LEFT JOIN l ON w.ts = l.ts""")
def q_pivot_scores(spark, d):
    names = shape.series_names(readings(spark, d))
    w = shape.to_wide(hourly(spark, d).withColumn("value", F.round("value", 6)), names)
    return w.join(point_labels(spark, d), "ts", "left")


# ---- item 28: cycle boundaries for every day of the data, 2 cycles/day ----
@query("cycle_bounds", sql=f"""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
c AS (SELECT day, CAST(i AS INTEGER) AS cycle, CAST(day AS TIMESTAMP) + INTERVAL (i * 12) HOUR AS start_ts
      FROM d, range(2) t(i))
SELECT day, cycle, start_ts, start_ts + INTERVAL 719 MINUTE AS end_ts,
       strftime(start_ts, '%H:%M') AS start_hhmm, strftime(start_ts + INTERVAL 719 MINUTE, '%H:%M') AS end_hhmm
FROM c""")
def q_cycle_bounds(spark, d):
    days = load(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return shape.cycle_bounds_for_days(days, 2)


# ---- item 12: between_time('00:00', '11:59'), both ends inclusive at minute labels ----
@query("time_of_day", sql="""
SELECT event_id, event_type AS sensor, ts FROM events
WHERE epoch_us(ts) % 86400000000 BETWEEN 0 AND 43140000000""")
def q_time_of_day(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("sensor"), "ts")
    return shape.between_time(e, "00:00", "11:59")


# ---- item 29: cycle truth, n = 2; flagged rows = error events above 200 ----
CYCLE_TRUTH_SQL = f"""
  WITH f AS (SELECT ts, 1 AS label FROM events WHERE event_type = 'error' AND value > 200),
  k AS (SELECT ts, label, epoch_us(ts) % {DAY_US} AS u FROM f),
  k2 AS (SELECT ts, label, (epoch_us(ts) // {DAY_US}) * {DAY_US} + (u // {HALF_US}) * {HALF_US} AS k
         FROM k WHERE u - (u // {HALF_US}) * {HALF_US} <= {HALF_US - 60 * 10**6}),
  c AS (SELECT k, arg_min(label, ts) AS label FROM k2 GROUP BY k),
  b AS (SELECT min(k) AS k0, max(k) AS k1 FROM c),
  g AS (SELECT unnest(range(k0, k1 + 1, {HALF_US})) AS k FROM b)
  SELECT make_timestamp(g.k) AS cycle_start, CAST(c.label AS INTEGER) AS label FROM g LEFT JOIN c ON g.k = c.k"""


def _truth(spark, d):
    e = load(spark, d, "events")
    flags = e.where((F.col("event_type") == "error") & (F.col("value") > 200)).select("ts", F.lit(1).alias("label"))
    return shape.cycle_truth(flags, 2)


@query("cycle_truth", sql=CYCLE_TRUTH_SQL)
def q_cycle_truth(spark, d):
    return _truth(spark, d)


# ---- items 30, 57: pad the truth over the whole horizon (first to last day) ----
PAD_SQL = f"""
  WITH t AS ({CYCLE_TRUTH_SQL}),
  h AS (SELECT epoch_us(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP)) AS t0,
               epoch_us(CAST(CAST(max(ts) AS DATE) AS TIMESTAMP)) AS t1 FROM events),
  g AS (SELECT unnest(range(0, (t1 - t0) // {HALF_US} + 2)) AS pos, t0 FROM h)
  SELECT make_timestamp(g.t0 + g.pos * {HALF_US}) AS cycle_start, g.pos,
         coalesce(CAST(t.label AS DOUBLE), 0.0) AS label
  FROM g LEFT JOIN t ON make_timestamp(g.t0 + g.pos * {HALF_US}) = t.cycle_start"""


def _padded(spark, d):
    e = load(spark, d, "events")
    horizon = e.agg(F.to_date(F.min("ts")).cast("timestamp_ntz").alias("start_day"),
                    F.to_date(F.max("ts")).cast("timestamp_ntz").alias("end_day"))
    return shape.pad_truth(_truth(spark, d), horizon, 2)


@query("pad_truth", sql=PAD_SQL)
def q_pad_truth(spark, d):
    return _padded(spark, d)


# ---- item 16: display floor 0 -> 0.05 over the padded truth ----
@query("period_index", sql=f"""
SELECT cycle_start, pos, label, CASE WHEN label = 0 THEN 0.05 ELSE label END AS display FROM ({PAD_SQL})""")
def q_period_index(spark, d):
    return shape.period_index(_padded(spark, d))


# ---- item 9: status filter, null-safe (missing status kept) ----
@query("status_filter", sql="""
SELECT event_id, event_type FROM events
WHERE event_type IS DISTINCT FROM 'view' AND event_type IS DISTINCT FROM 'click'""")
def q_status_filter(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type")
    return relational.status_filter(e, "event_type", exclude=["view", "click"])


# ---- item 14: status recode (error, signup -> 1, else 0) ----
@query("status_to_label", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 1 ELSE 0 END AS label
FROM events""")
def q_status_to_label(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", relational.recode("event_type", {"error": 1, "signup": 1}, default=0)
                    .cast("int").alias("label"))


# ---- item 11: positional slice iloc[N/4 : 3N/4] per series ----
@query("pos_slice", sql=f"""
WITH g AS ({binned_grid(3600)}), n AS (SELECT sensor, count(*) AS n FROM g GROUP BY sensor)
SELECT g.sensor, g.ts, g.pos, round(g.v, 6) AS value FROM g JOIN n ON g.sensor = n.sensor
WHERE g.pos >= n.n // 4 AND g.pos < (3 * n.n) // 4""")
def q_pos_slice(spark, d):
    g = hourly(spark, d)
    n = g.groupBy("sensor").agg(F.count(F.lit(1)).alias("_n"))
    x = g.join(n, "sensor").withColumn("_lo", F.floor(F.col("_n") / 4)).withColumn("_hi", F.floor(3 * F.col("_n") / 4))
    return relational.pos_slice(x, "_lo", "_hi").select("sensor", "ts", "pos", F.round("value", 6).alias("value"))
