"""Anomaly evaluation.

Segments are islands of consecutive label=1 rows per series. The island scan
is bucketed by day: the previous label across a bucket edge comes from a
per-bucket summary and segment numbers from an exact two-level running count,
so no task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import US_PER_SEC, epoch_us, step_us
from .bucketing import bucketed_cumsum, bucketed_window
from .stats import prf

DAY_US = 86400 * US_PER_SEC
HOUR_US = 3600 * US_PER_SEC


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def time_buckets(df: DataFrame, keys, ts: str = "ts", target_rows: int = 1_000_000,
                 out: str = "_day") -> DataFrame:
    """Monotone time buckets per series sized to about ``target_rows`` rows:
    width = max(1 s, span * target / n) from one small per-series aggregate,
    so a hot sensor gets narrow buckets and a sparse one wide buckets."""
    keys = _keys(keys)
    us = epoch_us(ts)
    st = (df.groupBy(*keys).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"), F.count(F.lit(1)).alias("_n"))
            .select(*keys, "_t0", F.greatest(F.lit(US_PER_SEC),
                                             F.ceil((F.col("_t1") - F.col("_t0") + 1) * F.lit(float(target_rows))
                                                    / F.col("_n"))).cast("long").alias("_w")))
    return (df.join(st, keys).withColumn(out, F.floor((us - F.col("_t0")) / F.col("_w")).cast("long"))
              .drop("_t0", "_w"))


def with_segments(df: DataFrame, keys, ts: str = "ts", label: str = "label",
                  bucket_rows: int = 1_000_000) -> DataFrame:
    """Add ``seg_no`` (running count of segment starts) per series; rows with
    label = 1 share the seg_no of their segment. Windows run per
    (series, time bucket) of about ``bucket_rows`` rows; the previous label
    across a bucket edge and the running count come from bucket summaries."""
    keys = _keys(keys)
    x = time_buckets(df, keys, ts, bucket_rows)
    w = Window.partitionBy(*keys, "_day").orderBy(ts)
    x = x.withColumn("_prev", F.lag(label).over(w))
    last = x.groupBy(*keys, "_day").agg(F.max_by(label, ts).alias("_last"))
    last = last.withColumn("_pb", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")))
    x = x.join(last.select(*keys, "_day", "_pb"), [*keys, "_day"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_pb"))
    x = x.withColumn("_start", F.when((F.col(label) == 1) & (prev.isNull() | (prev != 1)), 1).otherwise(0))
    x = bucketed_cumsum(x, keys, ts, "_start", "seg_no", "_day")
    return x.drop("_prev", "_pb", "_start", "_day")


def segments(df: DataFrame, keys, ts: str = "ts", label: str = "label") -> DataFrame:
    """Segments table ``(keys, seg_no, seg_start, seg_end, n_points)``."""
    keys = _keys(keys)
    s = with_segments(df, keys, ts, label)
    return (s.where(F.col(label) == 1).groupBy(*keys, "seg_no")
             .agg(F.min(ts).alias("seg_start"), F.max(ts).alias("seg_end"),
                  F.count(F.lit(1)).alias("n_points")))


def _materialize(df: DataFrame, cols, materialize: bool) -> DataFrame:
    """The evaluators read their input in several branches (segment buckets
    and summaries, alarms, per-key counts). With ``materialize`` the needed
    columns are written once (reliable checkpoint in the shared
    ``spark.checkpoint.dir``), so an expensive upstream (a fence pipeline,
    a wide scan) is evaluated once instead of once per branch."""
    x = df.select(*cols)
    if not materialize:
        return x
    from ..session import cut_lineage
    return cut_lineage(x)


def point_adjusted(df: DataFrame, keys, ts: str = "ts", label: str = "label", alarm: str = "alarm",
                   digits: int = 6, materialize: bool = True) -> DataFrame:
    """Point-adjusted precision/recall/F1 and mean time to detect.

    A segment with any alarm counts all its points as TP, otherwise as FN;
    every alarm outside segments is an FP. MTTD = mean over detected
    segments of (first alarm - segment start), in seconds.
    """
    keys = _keys(keys)
    df = _materialize(df, [*keys, ts, label, alarm], materialize)
    s = with_segments(df, keys, ts, label)
    seg = (s.where(F.col(label) == 1).groupBy(*keys, "seg_no")
            .agg(F.min(ts).alias("_s0"), F.count(F.lit(1)).alias("_n"),
                 F.max(F.col(alarm)).alias("_hit"),
                 F.min(F.when(F.col(alarm) == 1, F.col(ts))).alias("_first")))
    seg_agg = seg.groupBy(*keys).agg(
        F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(F.col("_hit") == 1, 0).otherwise(F.col("_n"))).cast("long").alias("fn"),
        F.sum(F.when(F.col("_hit") == 1, 1).otherwise(0)).cast("long").alias("n_detected"),
        F.count(F.lit(1)).alias("n_segments"),
        F.avg(F.when(F.col("_hit") == 1,
                     (epoch_us("_first") - epoch_us("_s0")) / F.lit(float(US_PER_SEC)))).alias("mttd_s"))
    fp = (df.groupBy(*keys)
            .agg(F.sum(F.when((F.col(alarm) == 1) & (F.col(label) != 1), 1).otherwise(0)).cast("long").alias("fp")))
    x = fp.join(seg_agg, keys, "left").fillna(0, ["tp", "fn", "n_detected", "n_segments"])
    x = prf(x, digits=digits)
    return x.select(*keys, "tp", "fp", "fn", "n_segments", "n_detected", "precision", "recall", "f1",
                    F.round("mttd_s", digits).alias("mttd_s"))


def _bucketed_range_join(alarms: DataFrame, segs: DataFrame, keys, early_us: int, how: str,
                         bucket_us: int = HOUR_US) -> DataFrame:
    """alarms ts in [seg_start - early, seg_end] as an equi-join on
    (keys, hour bucket) plus the range predicate; each segment is copied into
    every bucket its widened span touches (segments are short, so few copies;
    a skewed bucket is split by AQE's skew-join handling)."""
    keys = _keys(keys)
    a = alarms.withColumn("_ab", F.floor(epoch_us("ts") / F.lit(bucket_us)).cast("long"))
    s = segs.withColumn("_lo", epoch_us("seg_start") - F.lit(early_us)).withColumn("_hi", epoch_us("seg_end"))
    s = s.withColumn("_ab", F.explode(F.sequence(F.floor(F.col("_lo") / bucket_us).cast("long"),
                                                   F.floor(F.col("_hi") / bucket_us).cast("long"))))
    cond = [a["_ab"] == s["_ab"]] + [a[k] == s[k] for k in keys] + \
           [epoch_us(a["ts"]) >= s["_lo"], epoch_us(a["ts"]) <= s["_hi"]]
    if how == "left_anti":
        return a.join(s, cond, "left_anti").drop("_ab")
    return (a.join(s, cond, "inner")
             .select(*[a[k] for k in keys], a["ts"], s["seg_no"], s["seg_start"], s["seg_end"]))


def early_alarms(alarms: DataFrame, segs: DataFrame, keys, early_s: int = 600) -> DataFrame:
    """(item 36) alarms inside a segment widened by ``early_s`` before its start."""
    return _bucketed_range_join(alarms, segs, keys, early_s * US_PER_SEC, "inner")


def false_alarms(alarms: DataFrame, segs: DataFrame, keys, early_s: int = 600) -> DataFrame:
    """(item 37) alarms matching no widened segment (left anti range join)."""
    return _bucketed_range_join(alarms, segs, keys, early_s * US_PER_SEC, "left_anti")


def revised_point_adjusted(df: DataFrame, keys, ts: str = "ts", label: str = "label", alarm: str = "alarm",
                           early_s: int = 600, digits: int = 6, materialize: bool = True) -> DataFrame:
    """Revised point-adjusted metrics: TP/FN per segment (an alarm up to
    ``early_s`` before the start counts), FP per alarm outside all widened
    segments; MTTD without the early allowance."""
    keys = _keys(keys)
    df = _materialize(df, [*keys, ts, label, alarm], materialize)
    segs = segments(df, keys, ts, label)
    alarms = df.where(F.col(alarm) == 1).select(*keys, ts)
    hits = early_alarms(alarms, segs, keys, early_s)
    det = (hits.groupBy(*keys, "seg_no")
               .agg(F.min(F.when(F.col("ts") >= F.col("seg_start"), F.col("ts"))).alias("_first"),
                    F.first("seg_start").alias("_s0")))
    per = segs.join(det.select(*keys, "seg_no", F.lit(1).alias("_hit"), "_first"), [*keys, "seg_no"], "left")
    seg_agg = per.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("_hit"), F.lit(0))).cast("long").alias("tp"),
        F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("fn"),
        F.count(F.lit(1)).alias("n_segments"),
        F.avg((epoch_us("_first") - epoch_us("seg_start")) / F.lit(float(US_PER_SEC))).alias("mttd_s"))
    fp = false_alarms(alarms, segs, keys, early_s).groupBy(*keys).agg(F.count(F.lit(1)).alias("fp"))
    base = df.select(*keys).distinct()
    x = (base.join(seg_agg, keys, "left").join(fp, keys, "left")
             .fillna(0, ["tp", "fn", "fp", "n_segments"]))
    x = prf(x, digits=digits)
    return x.select(*keys, "tp", "fp", "fn", "n_segments", "precision", "recall", "f1",
                    F.round("mttd_s", digits).alias("mttd_s"))


def alarm_episodes(df: DataFrame, keys, gap: str = "10 minutes", ts: str = "ts", bucket_s: int = 3600) -> DataFrame:
    """Episodes of alarms: a gap of at least ``gap`` closes an episode (end =
    last alarm + gap).

    Alarms are counted per distinct time and handled per (key, time bucket), so
    no task sorts a whole sensor. A bucket is at least ``gap`` long: the alarm
    before a bucket's first one can only matter if it lies in the bucket before.
    Keys are not null; alarms without a time belong to no episode.
    """
    keys = _keys(keys)
    gap_us = step_us(gap)
    width = max(bucket_s * US_PER_SEC, gap_us)
    x = (df.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_us", epoch_us("_ts")).withColumn("_tb", F.floor(F.col("_us") / width).cast("long")))
    before = x.groupBy(*keys, "_tb").agg(F.max("_us").alias("_prev")).withColumn("_tb", F.col("_tb") + 1)
    lag = F.lag("_us").over(bucketed_window(keys, "_us", "_tb"))
    x = (x.join(before, [*keys, "_tb"], "left")
          .withColumn("_prev", F.coalesce(lag, "_prev"))
          .withColumn("_first", F.when(F.col("_us") - F.col("_prev") < gap_us, 0).otherwise(1)))
    x = bucketed_cumsum(x, keys, "_us", "_first", "_episode", "_tb")
    return (x.groupBy(*keys, "_episode")
             .agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.sum("_c").alias("n_alarms"))
             .select(*keys, "start", (F.col("end") + F.expr(f"interval {gap_us} microseconds")).alias("end"), "n_alarms"))
