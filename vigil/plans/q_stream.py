"""Streaming queries. Each runs the stream to the end
of the available input (``availableNow``) into a Parquet sink in the shared
checkpoint folder and returns the sink contents as a DataFrame, with event
times cast back to naive timestamps (UTC session).

On a fixed input the stream output is a deterministic function of the table,
so each has a batch oracle: windows and episodes are emitted once the final
watermark (max event time - 1 hour) passes their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load
from ..streaming import stream as S
from .registry import query


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


WM = "(SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)"


@query("stream_ingest", sql="""
SELECT 'events' AS measurement, 'Original' AS stamp, event_type AS field, ts, value, CAST(ts AS DATE) AS day
FROM (SELECT DISTINCT ON (event_type, ts) * FROM events) WHERE value IS NOT NULL""")
def q_stream_ingest(spark, d):
    path = S.run_dir(spark, "ingest")
    S.ingest(S.read_events_stream(spark, d), path)
    return _ntz(spark.read.parquet(path + "/out").drop("batch"), "ts")


@query("stream_window_stddev", sql=f"""
WITH w AS (SELECT event_type AS sensor, epoch_us(ts) // 1200000000 AS b, round(stddev_samp(value), 6) AS stddev,
                  round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type, epoch_us(ts) // 1200000000)
SELECT sensor, make_timestamp(b * 1200000000) AS start, make_timestamp((b + 1) * 1200000000) AS stop, stddev, mean, n
FROM w, {WM} m WHERE make_timestamp((b + 1) * 1200000000) <= m.wm""")
def q_stream_window_stddev(spark, d):
    path = S.run_dir(spark, "window")
    S.run_to_parquet(S.window_stats(S.as_readings(S.read_events_stream(spark, d))), path)
    out = S.read_back(spark, path).withColumn("stddev", F.round("stddev", 6)).withColumn("mean", F.round("mean", 6))
    return _ntz(out, "start", "stop")


@query("stream_zscore", sql="""
WITH b AS (SELECT event_type AS sensor, hour(ts) AS slot, avg(value) AS mean, stddev_samp(value) AS std
           FROM events GROUP BY ALL),
z AS (SELECT e.event_type AS sensor, e.ts, e.value, round((e.value - b.mean) / nullif(b.std, 0), 6) AS z_raw
      FROM events e LEFT JOIN b ON e.event_type = b.sensor AND hour(e.ts) = b.slot)
SELECT sensor, ts, value, CASE WHEN abs(z_raw) >= 3 THEN z_raw ELSE 0.0 END AS z FROM z""")
def q_stream_zscore(spark, d):
    base = (load(spark, d, "events")
            .groupBy(F.col("event_type").alias("sensor"), F.hour("ts").alias("slot"))
            .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))
    path = S.run_dir(spark, "zscore")
    S.run_to_parquet(S.zscore_alarms(S.as_readings(S.read_events_stream(spark, d)), base), path)
    return _ntz(S.read_back(spark, path), "ts")


@query("stream_episodes", sql="""
WITH a AS (SELECT event_type AS sensor, ts FROM events WHERE value > 150.0 OR (value > 60.0 AND user_id % 5 = 0)),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM a),
x AS (SELECT *, lag(ts) OVER (PARTITION BY sensor ORDER BY ts) AS prev FROM a),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 10 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM x),
e AS (SELECT sensor, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n_alarms FROM y GROUP BY sensor, ep)
SELECT e.* FROM e, m WHERE e."end" <= m.wm""")
def q_stream_episodes(spark, d):
    from .domain import ALARM_LOW, ALARM_THRESHOLD, ALARM_USER_MOD
    st = S.read_events_stream(spark, d)
    alarms = st.where((F.col("value") > ALARM_THRESHOLD)
                      | ((F.col("value") > ALARM_LOW) & (F.pmod("user_id", F.lit(ALARM_USER_MOD)) == 0)))
    path = S.run_dir(spark, "episodes")
    S.run_to_parquet(S.episodes(S.as_readings(alarms.drop("props"))), path)
    return _ntz(S.read_back(spark, path), "start", "end")


@query("stream_ffill", sql="""
WITH bins AS (SELECT event_type AS sensor, epoch_us(ts) // 60000000 AS b, max(struct_pack(ts := ts, value := value)).value AS v
              FROM events WHERE value IS NOT NULL GROUP BY ALL),
wm AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS ms FROM events WHERE value IS NOT NULL),
bounds AS (SELECT sensor, min(b) AS b0 FROM bins GROUP BY sensor),
g AS (SELECT sensor, unnest(range(b0, ms // 60000)) AS b FROM bounds, wm),
j AS (SELECT g.sensor, g.b, bins.v FROM g LEFT JOIN bins ON g.sensor = bins.sensor AND g.b = bins.b),
f AS (SELECT sensor, b, v, last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY b
      ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS fv FROM j)
SELECT sensor, make_timestamp(b * 60000000) AS ts, fv AS value, v IS NULL AS filled FROM f WHERE fv IS NOT NULL""")
def q_stream_ffill(spark, d):
    path = S.run_dir(spark, "ffill")
    S.run_to_parquet(S.ffill_stream(S.as_readings(S.read_events_stream(spark, d)), 60), path)
    return _ntz(S.read_back(spark, path), "ts")
