"""Regular time grid: regularise, resample, windowed aggregates and fills.

The long ``readings(sensor, ts, value)`` table is the unit of work. A regular
series gets an integer ``pos`` = (ts - t0) / step; every positional operation
downstream (slices, chunks, folds, phases) is arithmetic on ``pos`` and stays
map-only.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import group_median
from ..functions import time
from ..functions.time import epoch_us, from_epoch_us
from ..session import cut_lineage
from .bucketing import DEFAULT_BUCKET, carry_forward, with_halo

# grid positions generated per row before a block is exploded
GRID_BLOCK = 4096


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def grid_frame(bounds: DataFrame, keys, t0: str, n: str, step_us: int,
               ts_out: str = "ts", block: int = GRID_BLOCK) -> DataFrame:
    """Rows ``keys, pos, ts`` for pos in [0, n) per key.

    Generation is split into blocks of ``block`` positions and the block rows
    are spread over the cluster before exploding, so one long series is not
    generated by one task.
    """
    keys = _keys(keys)
    blocks = (bounds.select(*keys, t0, n,
                            F.explode(F.sequence(F.lit(0).cast("long"),
                                                 F.floor((F.col(n) - 1) / block).cast("long"))).alias("_blk"))
                    .repartition(*keys, "_blk"))
    pos = blocks.select(
        *keys, t0,
        F.explode(F.sequence(F.col("_blk") * block,
                             F.least(F.col(n) - 1, F.col("_blk") * block + (block - 1)))).alias("pos"))
    return pos.select(*keys, "pos",
                      from_epoch_us(F.col(t0) + F.col("pos") * F.lit(step_us)).alias(ts_out))


def regularize(df: DataFrame, step: str | int, keys="sensor", ts: str = "ts",
               values: Sequence[str] | None = None, anchor: str = "first") -> DataFrame:
    """pandas ``asfreq``: per key a grid from the first to the last timestamp
    at a fixed step. Rows off the grid are dropped; grid points without a row
    get NULL values. Adds ``pos`` (0-based step index).

    ``anchor='first'`` starts the grid at the first timestamp (pandas);
    ``anchor='epoch'`` floors it to an epoch-aligned step boundary.
    """
    keys = _keys(keys)
    values = list(values) if values is not None else [c for c in df.columns if c not in keys + [ts]]
    step_us = time.step_us(step)
    x = df.select(*keys, epoch_us(ts).alias("_us"), *values)
    t0 = F.min("_us")
    if anchor == "epoch":
        t0 = F.floor(F.min("_us") / step_us).cast("long") * step_us
    bounds = (x.groupBy(*keys)
               .agg(t0.alias("_t0"), F.max("_us").alias("_t1"))
               .withColumn("_n", F.floor((F.col("_t1") - F.col("_t0")) / step_us).cast("long") + 1))
    grid = grid_frame(bounds, keys, "_t0", "_n", step_us, ts_out=ts)
    on_grid = (x.join(bounds.select(*keys, "_t0"), on=keys)
                .where(F.pmod(F.col("_us") - F.col("_t0"), F.lit(step_us)) == 0)
                .select(*keys, ((F.col("_us") - F.col("_t0")) / F.lit(step_us)).cast("long").alias("pos"),
                        *values))
    return grid.join(on_grid, on=[*keys, "pos"], how="left").select(*keys, ts, "pos", *values)


_AGG = {
    "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max,
    "sum": F.sum, "count": F.count, "stddev": F.stddev_samp, "first": None, "last": None,
}


def agg_expr(fn: str, value: str) -> Column:
    if fn == "first":
        return F.min_by(value, "ts")
    if fn == "last":
        return F.max_by(value, "ts")
    if fn == "count":
        return F.count(value).cast("long")
    return _AGG[fn](value)


def _bin_stats(df: DataFrame, keys, ts: str, value: str, step_us: int, fns: dict[str, str]) -> DataFrame:
    """``keys, _b`` (absolute bin index) and one column per entry of ``fns``
    (column -> function), for every bin with rows.

    Everything but the median is one hash aggregate with map-side partials.
    Medians go through ``group_median``, which is exact and holds one value
    range of a bin at a time, however dense the bin is. Callers read the bins
    twice (bounds and values), so a table with medians is written once.
    """
    x = df.select(*keys, ts, value).withColumn("_b", F.floor(epoch_us(ts) / step_us).cast("long"))
    aggs = [agg_expr(fn, value).alias(c) for c, fn in fns.items() if fn != "median"]
    bins = x.groupBy(*keys, "_b").agg(*aggs) if aggs else x.select(*keys, "_b").distinct()
    for c in (c for c, fn in fns.items() if fn == "median"):
        bins = bins.join(group_median(x, [*keys, "_b"], value, c), [*keys, "_b"], "left")
    return cut_lineage(bins) if "median" in fns.values() else bins


def _on_bin_grid(binned: DataFrame, keys, ts: str, step_us: int) -> DataFrame:
    """``binned`` on the full grid from each key's first to its last bin.

    The grid carries the absolute bin index, so the binned values join on
    (keys, bin) directly."""
    bounds = (binned.groupBy(*keys)
                    .agg(F.min("_b").alias("_b0"), F.max("_b").alias("_b1"))
                    .select(*keys, (F.col("_b0") * step_us).alias("_t0"),
                            (F.col("_b1") - F.col("_b0") + 1).alias("_n"), "_b0"))
    grid = (grid_frame(bounds, keys, "_t0", "_n", step_us, ts_out=ts)
            .withColumn("_b", F.floor(epoch_us(ts) / step_us).cast("long")))
    return grid.join(binned, on=[*keys, "_b"], how="left")


def resample(df: DataFrame, step: str | int, fn: str = "median", keys="sensor", ts: str = "ts",
             value: str = "value", out: str | None = None) -> DataFrame:
    """pandas ``resample(step).<fn>()``: bins left-closed and left-labelled,
    epoch aligned; empty bins between the first and last bin are NULL
    (``count`` gives 0). Adds ``pos``."""
    keys = _keys(keys)
    out = out or value
    step_us = time.step_us(step)
    res = _on_bin_grid(_bin_stats(df, keys, ts, value, step_us, {out: fn}), keys, ts, step_us)
    if fn == "count":
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))
    return res.select(*keys, ts, "pos", out)


def window_aggregate(df: DataFrame, every: str | int, fn: str = "stddev", keys="sensor",
                     ts: str = "ts", value: str = "value", out: str = "value",
                     create_empty: bool = True, label: str = "stop",
                     start=None, stop=None) -> DataFrame:
    """Flux ``aggregateWindow(every, fn, createEmpty)``.

    Windows are ``[k*every, (k+1)*every)`` (epoch aligned) and labelled by
    their stop (``label='stop'``) or start. With ``create_empty`` every window
    between the first and last one of each key is returned; an empty window
    gives NULL (``count``: 0). ``start``/``stop`` restrict the range first
    (start inclusive, stop exclusive) and then define the window span.
    """
    keys = _keys(keys)
    x = df
    if start is not None:
        x = x.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        x = x.where(F.col(ts) < F.lit(stop).cast("timestamp_ntz"))
    step_us = time.step_us(every)
    if create_empty:
        r = resample(x, every, fn, keys, ts, value, out)
    else:
        r = (_bin_stats(x, keys, ts, value, step_us, {out: fn})
              .select(*keys, from_epoch_us(F.col("_b") * F.lit(step_us)).alias(ts), out))
    if label == "stop":
        r = r.withColumn(ts, from_epoch_us(epoch_us(ts) + F.lit(step_us)))
    return r


def fill_previous(df: DataFrame, keys="sensor", pos: str = "pos", value: str = "value",
                  out: str | None = None, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Flux ``fill(usePrevious: true)``: NULL takes the last non-null earlier
    value of its series (unbounded look-back). Two-level bucketed scan."""
    out = out or value
    keys = _keys(keys)
    res = carry_forward(df, keys, pos, value, "_filled", bucket=bucket)
    return res.drop(out).withColumnRenamed("_filled", out)


def ffill_limit(df: DataFrame, limit: int = 60, keys="sensor", pos: str = "pos",
                values: Iterable[str] = ("value",), bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """pandas ``fillna(method='ffill', limit=n)`` on a regular grid: a NULL is
    filled with the last value at most ``limit`` rows back.

    Evaluated per (key, pos bucket) with a halo of ``limit`` rows, so no task
    holds a whole series.
    """
    keys = _keys(keys)
    values = list(values)
    h = with_halo(df, pos, limit, bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(pos).rowsBetween(-int(limit), 0)
    for v in values:
        h = h.withColumn(v, F.last(v, ignorenulls=True).over(w))
    return h.where(~F.col("_halo")).drop("_bkt", "_halo")


def fill_constant(df: DataFrame, value_by_key: dict, key: str = "sensor", value: str = "value") -> DataFrame:
    """``fillna(value=c)`` restricted to the series named in ``value_by_key``."""
    expr = None
    for k, c in value_by_key.items():
        cond = F.col(key) == F.lit(k)
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    if expr is None:
        return df
    return df.withColumn(value, F.coalesce(F.col(value), expr))


def window_stats(df: DataFrame, every: str | int, fns=("mean", "median", "min", "max", "sum", "count", "stddev"),
                 keys="sensor", ts: str = "ts", value: str = "value", label: str = "stop") -> DataFrame:
    """aggregateWindow for several functions in one pass (medians in their
    own): every window between a key's first and last one is returned (empty
    windows: NULL statistics, count 0); columns are named after the functions."""
    keys = _keys(keys)
    step_us = time.step_us(every)
    res = _on_bin_grid(_bin_stats(df, keys, ts, value, step_us, {f: f for f in fns}), keys, ts, step_us)
    if "count" in fns:
        res = res.withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("long")))
    if label == "stop":
        res = res.withColumn(ts, from_epoch_us(epoch_us(ts) + F.lit(step_us)))
    return res.select(*keys, ts, "pos", *fns)
