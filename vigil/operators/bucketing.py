"""Bucketed windows for long series.

A window ``partitionBy(sensor).orderBy(pos)`` puts a whole sensor into one
task. With few sensors and long history that task holds a third of the data.
On a regular grid (``pos`` = step index, every position present) a window that
looks back at most ``halo`` rows can instead be evaluated per
``(sensor, pos div bucket)``: each bucket receives a copy of the last ``halo``
rows of the previous bucket, the window runs inside the bucket, and the copies
are dropped again. The result is exact for any ``bucket >= halo``.

For unbounded look-back (running fills, running sums) a multi-level scan is
used: a per-bucket summary (one row per bucket), the same scan one level up
over the summaries, and an equi-join back. No step ever needs a whole series
in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 4096


def with_halo(df: DataFrame, pos: str, halo: int, bucket: int = DEFAULT_BUCKET,
              bucket_col: str = "_bkt", halo_col: str = "_halo") -> DataFrame:
    """Add ``bucket_col`` and duplicate the trailing ``halo`` rows of every
    bucket into the next bucket, flagged by ``halo_col``."""
    bucket = max(int(bucket), int(halo), 1)
    b = F.floor(F.col(pos) / F.lit(bucket)).cast("long")
    if halo <= 0:
        return df.withColumn(bucket_col, b).withColumn(halo_col, F.lit(False))
    # one pass: every row once, plus a flagged copy for the trailing rows of
    # its bucket (a union of two filters would evaluate ``df`` twice)
    tail = F.pmod(F.col(pos), F.lit(bucket)) >= F.lit(bucket - halo)
    flags = F.when(tail, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    x = df.withColumn(halo_col, F.explode(flags))
    return x.withColumn(bucket_col, b + F.col(halo_col).cast("long"))


def bucketed_window(keys, pos: str, bucket_col: str = "_bkt") -> Window:
    return Window.partitionBy(*keys, bucket_col).orderBy(pos)


def carry_forward(df: DataFrame, keys, pos: str, value: str, out: str,
                  bucket: int = DEFAULT_BUCKET, levels: int = 3, exclusive: bool = False) -> DataFrame:
    """``out`` = last non-null ``value`` at or before ``pos`` per key
    (unbounded look-back; strictly before with ``exclusive``).

    Rows are scanned per (key, pos bucket); the carry into a bucket is the
    same problem one level up, over one summary row per bucket. Each level
    divides the rows per key by ``bucket``, and only the top level runs a
    window over a whole key: with 3 levels and bucket 4096 that is
    n / 4096^2 rows (about 60k at 10^12 rows in one series)."""
    keys = list(keys)
    # column names are per level, so nested levels never clash
    b, inner, last, carry = (f"_{n}{levels}" for n in ("bkt", "in", "last", "carry"))
    x = df.withColumn(b, F.floor(F.col(pos) / F.lit(bucket)).cast("long"))
    w_in = Window.partitionBy(*keys, b).orderBy(pos).rowsBetween(Window.unboundedPreceding,
                                                                 -1 if exclusive else 0)
    x = x.withColumn(inner, F.last(value, ignorenulls=True).over(w_in))
    # one summary row per bucket: its last non-null value (NULL if none)
    summary = (x.groupBy(*keys, b)
                .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias(last)))
    if levels > 2:
        summary = carry_forward(summary, keys, b, last, carry, bucket, levels - 1, exclusive=True)
    else:
        w_b = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        summary = summary.withColumn(carry, F.last(last, ignorenulls=True).over(w_b))
    x = x.join(summary.select(*keys, b, carry), on=[*keys, b], how="left")
    return x.withColumn(out, F.coalesce(inner, carry)).drop(inner, carry, b)


def bucketed_cumsum(df: DataFrame, keys, order: str, value: str, out: str,
                    bucket_col: str) -> DataFrame:
    """Exact running sum of ``value`` ordered by ``order`` per key where
    ``bucket_col`` is monotone in ``order`` (e.g. a day or pos bucket)."""
    keys = list(keys)
    w_in = Window.partitionBy(*keys, bucket_col).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_cs", F.sum(value).over(w_in))
    tot = df.groupBy(*keys, bucket_col).agg(F.sum(value).alias("_bt"))
    w_b = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(w_b), F.lit(0)))
    return (x.join(tot.select(*keys, bucket_col, "_off"), on=[*keys, bucket_col], how="left")
             .withColumn(out, F.col("_cs") + F.col("_off")).drop("_cs", "_off"))
