"""Series shaping on the regular grid.

Everything positional is arithmetic on ``pos``: splits, chunks, folds and
scenarios are map-side expressions or joins with tiny parameter tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid
from ..functions.quantiles import group_median
from ..functions.time import US_PER_SEC, epoch_us, from_epoch_us


# ---------------------------------------------------------------- item 24
def impute(df: DataFrame, step: str = "1 minute", keys="sensor", value: str = "value",
           drop=(), zero_fill=(), limit: int = 60, regular: bool = False,
           materialize: bool = True) -> DataFrame:
    """The reference's imputation pipeline on long readings:
    regularise -> drop series -> constant 0 for named series -> forward fill
    (limit rows) -> median of the *filled* series for what is left.

    ``regular=True`` means ``df`` is already on the grid (has ``pos``).
    ``materialize`` writes the filled grid once (reliable checkpoint in the
    shared ``spark.checkpoint.dir``): the median and the fill both read it,
    and so does every detector built on the result, instead of re-running
    the resample/fill shuffles per use; it also cuts the lineage.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    g = df if regular else grid.resample(df, step, "median", keys, value=value)
    if drop:
        g = g.where(~F.col(keys[0]).isin(list(drop)))
    g = grid.fill_constant(g, {s: 0.0 for s in zero_fill}, key=keys[0], value=value)
    g = grid.ffill_limit(g, limit, keys, values=[value])
    if materialize:
        from ..session import cut_lineage
        g = cut_lineage(g)
    med = group_median(g, keys, value, "_med")
    return (g.join(med, keys, "left")
             .withColumn(value, F.coalesce(F.col(value), F.col("_med"))).drop("_med"))


def any_null(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.bool_or(F.col(value).isNull()).alias("any_null"))


# ---------------------------------------------------------------- item 25
def chunk_series(df: DataFrame, n: int, keys="sensor", pos: str = "pos", value: str = "value",
                 ts: str = "ts", start_pos=None, out: str = "vals") -> DataFrame:
    """Consecutive length-``n`` chunks (incomplete tail dropped) as
    ``(keys, chunk_id, start_ts, <out> ARRAY<DOUBLE>)``. Each group holds
    exactly one chunk (``n`` values), so group size is bounded by ``n``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rel = F.col(pos) - (F.lit(0) if start_pos is None else F.col(start_pos))
    x = df.withColumn("_rel", rel).withColumn("chunk_id", F.floor(F.col("_rel") / n).cast("long"))
    g = (x.groupBy(*keys, "chunk_id")
          .agg(F.min(ts).alias("start_ts"), F.count(F.lit(1)).alias("_n"),
               F.sort_array(F.collect_list(F.struct(F.col("_rel").alias("p"), F.col(value).alias("v"))))
               .alias("_a")))
    return (g.where(F.col("_n") == n)
             .select(*keys, "chunk_id", "start_ts", F.transform("_a", lambda s: s["v"]).alias(out)))


# ---------------------------------------------------------------- item 26
def chrono_split(df: DataFrame, frac: float, keys="sensor", pos: str = "pos") -> DataFrame:
    """First floor(frac*N) rows of each series -> 'train', the rest 'test'."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N"))
    return (df.join(n, keys)
              .withColumn("split", F.when(F.col(pos) < F.floor(F.lit(frac) * F.col("_N")), "train")
                          .otherwise("test")).drop("_N"))


# ---------------------------------------------------------------- item 27
def folds_table(spark: SparkSession, split: int, wf: int, wp: int | None = None,
                n_folds: int = 4, mode: str = "expanding") -> DataFrame:
    """Walk-forward folds as rows ``(fold, role, lo, hi)`` with [lo, hi).

    expanding: train [0, s+wf*i); test [s+wf*i, s+wf*(i+1)).
    sliding:   train [s+wf*i-wp, s-1+wf*i) (the reference drops the last
               row); test [s-1+wf*i, s+wf*(i+1)) with one leading context row.
    """
    rows = []
    for i in range(n_folds):
        if mode == "expanding":
            rows.append((i, "train", 0, split + wf * i))
            rows.append((i, "test", split + wf * i, split + wf * (i + 1)))
        else:
            rows.append((i, "train", max(split + wf * i - wp, 0), split - 1 + wf * i))
            rows.append((i, "test", split - 1 + wf * i, split + wf * (i + 1)))
    return spark.createDataFrame(rows, "fold int, role string, lo long, hi long")


#: Where a series of n rows is split when no bounds are given: training
#: takes 8/15 of it, the folds share the rest, and a sliding window holds 3/4
#: (a baseline's 7/16) of the first training part.
SPLIT_PART, SLIDING_PART, BASELINE_PART = (8, 15), (3, 4), (7, 16)


def series_folds(df: DataFrame, keys="sensor", n_folds: int = 4, mode: str = "expanding", pos: str = "pos") -> DataFrame:
    """Walk-forward folds (keys, fold, role, lo, hi) from each series' own
    length; the last test part ends with the series. Modes as in
    ``folds_table``, and ``baseline``: train [test - window, test)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = lambda x, p: F.floor(x * p[0] / p[1]).cast("long")
    n, s, wf = F.col("_n"), F.col("_s"), F.col("_wf")
    x = (df.groupBy(*keys).agg((F.max(pos) + 1).cast("long").alias("_n")).withColumn("_s", part(n, SPLIT_PART))
           .withColumn("_wf", F.floor((n - s) / n_folds).cast("long"))
           .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))))
    start, end = s + wf * F.col("fold"), F.when(F.col("fold") == n_folds - 1, n).otherwise(s + wf * (F.col("fold") + 1))
    if mode == "expanding":
        train, test = (F.lit(0).cast("long"), start), (start, end)
    elif mode == "sliding":
        train, test = (F.greatest(start - part(s, SLIDING_PART), F.lit(0)), start - 1), (start - 1, end)
    elif mode == "baseline":
        train, test = (F.greatest(start - part(s, BASELINE_PART), F.lit(0)), start), (start, end)
    else:
        raise ValueError(mode)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for r, (lo, hi) in (("train", train), ("test", test))])
    return x.select(*keys, "fold", F.inline(roles))


def walk_forward(df: DataFrame, folds: DataFrame, pos: str = "pos", keys="sensor") -> DataFrame:
    """Attach (fold, role) by a range predicate on ``pos``. Folds of a whole
    table (2 rows per fold) are broadcast; folds of their own series (those of
    ``series_folds``) meet it by an equi-join on the keys, 2 rows per fold and
    key, which the planner broadcasts while they are few."""
    keys = [k for k in ([keys] if isinstance(keys, str) else keys) if k in folds.columns]
    if not keys:
        f = F.broadcast(folds)
        return df.join(f, (F.col(pos) >= f.lo) & (F.col(pos) < f.hi), "inner").drop("lo", "hi")
    return df.join(folds, keys).where((F.col(pos) >= F.col("lo")) & (F.col(pos) < F.col("hi"))).drop("lo", "hi")


# ---------------------------------------------------------------- item 32
def scenario(df: DataFrame, t0_col: str, ts: str = "ts", days: int = 7) -> DataFrame:
    """scenario = floor(days since t0 / 7) + 1."""
    return df.withColumn("scenario", (F.floor(F.datediff(F.to_date(ts), F.to_date(t0_col)) / days) + 1)
                         .cast("int"))


# ---------------------------------------------------------------- item 33
def series_names(df: DataFrame, name_col: str = "sensor", most: int = 10_000) -> list:
    """The names in ``df``, sorted, null left out: the columns of a wide table.
    More than ``most`` (far beyond what a table has as columns) are an error,
    so what reaches the driver is bounded and no series is dropped."""
    names = [r[0] for r in df.where(F.col(name_col).isNotNull()).select(name_col).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values of {name_col}: too many for columns")
    return sorted(names)


def to_wide(df: DataFrame, names, key: str = "ts", name_col: str = "sensor", value: str = "value") -> DataFrame:
    """Long -> wide with an explicit column list (no distinct pass); see
    ``series_names`` for the list of all series in the data."""
    return df.groupBy(key).pivot(name_col, list(names)).agg(F.first(value))


def to_long(df: DataFrame, names, key: str = "ts", name_col: str = "sensor", value: str = "value") -> DataFrame:
    names = list(names)
    return df.unpivot([key], names, name_col, value)


# ---------------------------------------------------------------- items 12, 28-30
def cycle_len_s(n: int) -> int:
    if 24 % n:
        raise ValueError("cycles per day must divide 24")
    return 86400 // n


def cycle_of(ts, n: int):
    """(cycle index, inside) where inside applies the reference's minute-label
    inclusive windows: a row at 11:59:30 is in no 12-hour cycle."""
    us_day = F.pmod(epoch_us(ts), F.lit(86400 * US_PER_SEC))
    ln = cycle_len_s(n) * US_PER_SEC
    idx = F.floor(us_day / ln).cast("int")
    inside = (us_day - idx * ln) <= F.lit(ln - 60 * US_PER_SEC)
    return idx, inside


def between_time(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """pandas ``between_time(start, end)`` with both ends inclusive at minute
    labels (e.g. '00:00'..'11:59' keeps 11:59:00, not 11:59:30)."""
    def us(hm):
        h, m = hm.split(":")
        return (int(h) * 3600 + int(m) * 60) * US_PER_SEC
    us_day = F.pmod(epoch_us(ts), F.lit(86400 * US_PER_SEC))
    return df.where((us_day >= us(start)) & (us_day <= us(end)))


def cycle_bounds_for_days(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """Per day and cycle: start/end timestamps and 'HH:MM' labels; the end is
    the next start minus one minute."""
    ln = cycle_len_s(n)
    x = days.select(day, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cycle"))
    start_us = epoch_us(F.col(day).cast("timestamp_ntz")) + F.col("cycle") * F.lit(ln * US_PER_SEC)
    x = (x.withColumn("start_ts", from_epoch_us(start_us))
          .withColumn("end_ts", from_epoch_us(start_us + F.lit((ln - 60) * US_PER_SEC))))
    return x.select(day, "cycle", "start_ts", "end_ts",
                    F.date_format("start_ts", "HH:mm").alias("start_hhmm"),
                    F.date_format("end_ts", "HH:mm").alias("end_hhmm"))


def cycle_truth(flags: DataFrame, n: int, ts: str = "ts", label: str = "label") -> DataFrame:
    """``ground_truth(n, data)``: for every (day, cycle) with a flagged row the
    first flagged row's label, keyed at day + cycle offset, regularised to the
    cycle length between the first and last such cycle (NULL elsewhere)."""
    idx, inside = cycle_of(ts, n)
    ln = cycle_len_s(n) * US_PER_SEC
    x = (flags.where(inside)
              .withColumn("_k", F.floor(epoch_us(ts) / F.lit(86400 * US_PER_SEC)).cast("long")
                          * F.lit(86400 * US_PER_SEC) + idx * F.lit(ln))
              .groupBy("_k").agg(F.min_by(label, ts).alias(label)))
    x = x.withColumn("sensor", F.lit("_")).withColumn("cycle_start", from_epoch_us("_k"))
    r = grid.regularize(x.select("sensor", "cycle_start", label), ln // US_PER_SEC, keys="sensor",
                        ts="cycle_start", values=[label])
    return r.select("cycle_start", F.col(label).cast("int").alias(label))


def pad_truth(truth: DataFrame, horizon: DataFrame, n: int, label: str = "label",
              fill: float | None = 0.0) -> DataFrame:
    """Truth over a full horizon at the cycle step. ``horizon`` is a one-row
    frame with ``start_day`` and ``end_day`` (naive timestamps at midnight);
    the grid runs from start_day 00:00 to the last cycle of end_day. Cycles
    without truth get ``fill`` (None keeps NULL)."""
    ln = cycle_len_s(n) * US_PER_SEC
    bounds = horizon.select(
        F.lit("_").alias("sensor"), epoch_us("start_day").alias("_t0"),
        ((epoch_us("end_day") - epoch_us("start_day")) / F.lit(ln)).cast("long").alias("_m"))
    bounds = bounds.withColumn("_n", F.col("_m") + n)
    g = grid.grid_frame(bounds, "sensor", "_t0", "_n", ln, ts_out="cycle_start")
    out = g.join(truth, "cycle_start", "left").select("cycle_start", "pos", label)
    if fill is not None:
        out = out.withColumn(label, F.coalesce(F.col(label).cast("double"), F.lit(float(fill))))
    return out


def period_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Display floor: 0 -> 0.05, anything else kept."""
    return df.withColumn("display", F.when(F.col(label) == 0, F.lit(0.05)).otherwise(F.col(label).cast("double")))
