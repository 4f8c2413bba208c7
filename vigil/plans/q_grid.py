"""Queries over the regular time grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..sources.tables import load
from .domain import readings
from .registry import query
from .sqlbits import READINGS, binned_grid

HOUR = 3600
MINUTE = 60


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# ---- item 17: regularise (pandas asfreq, anchored at the first timestamp) ----
@query("regularize", sql=f"""
WITH r AS (SELECT event_type AS sensor, epoch_us(ts) AS us, value FROM events),
b AS (SELECT sensor, min(us) AS t0, max(us) AS t1 FROM r GROUP BY sensor),
g AS (SELECT sensor, t0, unnest(range(0, (t1 - t0) // {HOUR * 10**6} + 1)) AS pos FROM b),
o AS (SELECT r.sensor, (r.us - b.t0) // {HOUR * 10**6} AS pos, r.value
      FROM r JOIN b ON r.sensor = b.sensor WHERE (r.us - b.t0) % {HOUR * 10**6} = 0)
SELECT g.sensor, make_timestamp(g.t0 + g.pos * {HOUR * 10**6}) AS ts, g.pos, o.value
FROM g LEFT JOIN o ON g.sensor = o.sensor AND g.pos = o.pos""")
def q_regularize(spark, d):
    return grid.regularize(readings(spark, d), "1 hour", values=["value"])


# ---- item 18: resample + median ----
@query("resample_median", sql=f"""
SELECT sensor, ts, pos, round(v, 6) AS value FROM ({binned_grid(HOUR)})""")
def q_resample_median(spark, d):
    return _r6(grid.resample(readings(spark, d), "1 hour", "median"), "value")


# ---- item 19: aggregateWindow(every: 20m, fn: stddev, createEmpty: true) ----
@query("window_stddev", sql=f"""
SELECT sensor, ts + INTERVAL 20 MINUTE AS ts, pos, round(v, 6) AS value
FROM ({binned_grid(20 * MINUTE, 'stddev_samp(value)')})""")
def q_window_stddev(spark, d):
    return _r6(grid.window_aggregate(readings(spark, d), "20 minutes", "stddev"), "value")


# ---- item 20: fill(usePrevious: true) on the hourly median grid ----
@query("fill_previous", sql=f"""
SELECT sensor, ts, pos,
       round(last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
FROM ({binned_grid(HOUR)})""")
def q_fill_previous(spark, d):
    g = grid.resample(readings(spark, d), "1 hour", "median")
    return _r6(grid.fill_previous(g), "value")


# ---- item 21: ffill limit 60 on the 1-minute median grid ----
@query("ffill_limit", sql=f"""
SELECT sensor, ts, pos,
       round(last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
             ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), 6) AS value
FROM ({binned_grid(MINUTE)})""")
def q_ffill_limit(spark, d):
    g = grid.resample(readings(spark, d), "1 minute", "median")
    return _r6(grid.ffill_limit(g, 60), "value")


# ---- items 5, 10: time-range scan (start inclusive, stop exclusive) + field filter ----
POINTS_START, POINTS_STOP = "2024-01-08 00:00:00", "2024-01-15 00:00:00"


@query("points_range", sql=f"""
SELECT 'events' AS measurement, 'Original' AS stamp, event_type AS field, ts, value
FROM events
WHERE ts >= TIMESTAMP '{POINTS_START}' AND ts < TIMESTAMP '{POINTS_STOP}'
  AND (event_type = 'error' OR event_type = 'purchase')""")
def q_points_range(spark, d):
    from ..sources.points import points_range, to_points
    pts = to_points(load(spark, d, "events"), measurement="events", ts="ts",
                    field_col="event_type", value_col="value")
    return points_range(pts, POINTS_START, POINTS_STOP, measurement="events",
                        fields=["error", "purchase"])


# ---- item 4: wide/tagged frame -> points (NULL values are not stored) ----
@query("to_points", sql="""
SELECT 'events' AS measurement, 'Original' AS stamp, field, ts, value FROM (
  SELECT ts, 'value' AS field, value FROM events
  UNION ALL SELECT ts, 'user_id' AS field, CAST(user_id AS DOUBLE) AS value FROM events
) WHERE value IS NOT NULL""")
def q_to_points(spark, d):
    from ..sources.points import wide_to_points
    e = load(spark, d, "events").select("ts", "value", F.col("user_id").cast("double").alias("user_id"))
    return wide_to_points(e, measurement="events", fields=["value", "user_id"], ts="ts",
                          tags={"stamp": "Original"})


# ---- items 1, 39: scan and profile (rows, non-null counts, any-null flag per column) ----
_PROFILE_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("scan_profile", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_non_null, "
    f"(count(*) > count({c})) AS has_null FROM events" for c in _PROFILE_COLS))
def q_scan_profile(spark, d):
    from ..operators.stats import profile
    return profile(load(spark, d, "events"), _PROFILE_COLS)


# ---- item 19, generic fn: all window statistics in one pass (empty windows kept) ----
_WS = ["mean", "median", "min", "max", "sum", "count", "stddev"]


@query("window_stats", sql=f"""
SELECT sensor, ts + INTERVAL 20 MINUTE AS ts, pos, round(mean, 6) AS mean, round(median, 6) AS median,
       round("min", 6) AS "min", round("max", 6) AS "max", round("sum", 6) AS "sum", coalesce("count", 0) AS "count",
       round(stddev, 6) AS stddev
FROM (
  WITH r AS ({READINGS}),
  bins AS (SELECT sensor, epoch_us(ts) // 1200000000 AS b, avg(value) AS mean, median(value) AS median,
                  min(value) AS "min", max(value) AS "max", sum(value) AS "sum", count(value) AS "count",
                  stddev_samp(value) AS stddev FROM r GROUP BY sensor, epoch_us(ts) // 1200000000),
  bounds AS (SELECT sensor, min(b) AS b0, max(b) AS b1 FROM bins GROUP BY sensor),
  g AS (SELECT sensor, b0, unnest(range(b0, b1 + 1)) AS b FROM bounds)
  SELECT g.sensor, make_timestamp(g.b * 1200000000) AS ts, g.b - g.b0 AS pos, bins.mean, bins.median,
         bins."min", bins."max", bins."sum", bins."count", bins.stddev
  FROM g LEFT JOIN bins ON g.sensor = bins.sensor AND g.b = bins.b)""")
def q_window_stats(spark, d):
    x = grid.window_stats(readings(spark, d), "20 minutes", _WS)
    return _r6(x, "mean", "median", "min", "max", "sum", "stddev")


# ---- many-sensor variant (sensor = user_id): hourly mean grid, ffill limit 6 ----
USER_READINGS = "SELECT CAST(user_id AS VARCHAR) AS sensor, ts, value FROM events"


@query("many_sensor_fill", sql=f"""
SELECT sensor, ts, pos,
       round(last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY pos
             ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS value
FROM ({binned_grid(HOUR, 'avg(value)', src=USER_READINGS)})""")
def q_many_sensor_fill(spark, d):
    from .domain import user_readings
    g = grid.resample(user_readings(spark, d), "1 hour", "mean")
    return _r6(grid.ffill_limit(g, 6), "value")
