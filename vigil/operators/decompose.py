"""Additive seasonal decomposition, one-sided.

trend (even p): (x_t/2 + x_{t-1} + ... + x_{t-p+1} + x_{t-p}/2) / p, NULL for
t < p; (odd p): mean of x_{t-p+1..t}, NULL for t < p-1. seasonal = per-phase
mean of (x - trend) minus the mean of those phase means, phase = pos mod p.
resid = x - trend - seasonal.

The moving sum runs per (series, pos bucket) with a halo of p rows, so a long
series is spread over many tasks; the phase means are a (series x p) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bucketing import DEFAULT_BUCKET, bucketed_cumsum, with_halo


def decompose(df: DataFrame, period: int, keys="sensor", pos: str = "pos", value: str = "value",
              bucket: int = DEFAULT_BUCKET) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    p = int(period)
    h = with_halo(df, pos, p, bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(pos)
    if p % 2 == 0:
        s = F.sum(value).over(w.rowsBetween(-p, 0))
        lag = F.lag(value, p).over(w)
        trend = F.when(F.col(pos) >= p, (s - 0.5 * F.col(value) - 0.5 * lag) / p)
    else:
        s = F.sum(value).over(w.rowsBetween(-(p - 1), 0))
        trend = F.when(F.col(pos) >= p - 1, s / p)
    t = h.withColumn("trend", trend).where(~F.col("_halo")).drop("_bkt", "_halo")
    t = t.withColumn("_phase", F.pmod(F.col(pos), F.lit(p)))
    ph = (t.where(F.col("trend").isNotNull())
           .groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_a")))
    ph = ph.withColumn("seasonal", F.col("_a") - F.avg("_a").over(Window.partitionBy(*keys))).drop("_a")
    return (t.join(ph, [*keys, "_phase"], "left").drop("_phase")
             .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")))


def decompose_many(df: DataFrame, periods, keys="sensor", ts: str = "ts", pos: str = "pos", value: str = "value",
                   bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """The residuals for several periods in one pass: keys, ts, pos, period,
    resid (rows without a trend are left out).

    A running sum per series is made once (two levels of buckets); the moving
    sum of any period is then the difference of two of its entries, so each
    period costs two look-backs, not a scan of its own. Rows must hold every
    position of a series, without null values."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    periods = [int(p) for p in periods]
    bucket = max(int(bucket), max(periods) + 1)
    x = df.select(*keys, ts, pos, value).withColumn("_b", F.floor(F.col(pos) / bucket).cast("long"))
    x = bucketed_cumsum(x, keys, pos, value, "_run", "_b").drop("_b")
    h = with_halo(x, pos, max(periods) + 1, bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(pos)
    trends = []
    for p in periods:
        if p % 2 == 0:
            moving = F.col("_run") - F.coalesce(F.lag("_run", p + 1).over(w), F.lit(0.0))
            trend = F.when(F.col(pos) >= p, (moving - 0.5 * F.col(value) - 0.5 * F.lag(value, p).over(w)) / p)
        else:
            trend = F.when(F.col(pos) >= p - 1, (F.col("_run") - F.coalesce(F.lag("_run", p).over(w), F.lit(0.0))) / p)
        trends.append(F.struct(F.lit(p).alias("period"), (F.col(value) - trend).alias("_rest")))
    t = (h.withColumn("_t", F.array(*trends)).where(~F.col("_halo")).select(*keys, ts, pos, F.inline("_t"))
          .where(F.col("_rest").isNotNull()).withColumn("_phase", F.pmod(F.col(pos), F.col("period"))))
    means = t.groupBy(*keys, "period", "_phase").agg(F.avg("_rest").alias("_a"))
    means = means.withColumn("_s", F.col("_a") - F.avg("_a").over(Window.partitionBy(*keys, "period"))).drop("_a")
    return t.join(means, [*keys, "period", "_phase"]).select(*keys, ts, pos, "period", (F.col("_rest") - F.col("_s")).alias("resid"))
