"""Detectors as Spark jobs.

Each detector has a fit stage that produces a small model table (one row per
fold x series x slot, or per fold x series) and a score stage that joins it
back to the readings by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import inv_norm
from ..functions.quantiles import group_median, group_quantiles
from ..functions.time import epoch_s
from .shape import walk_forward


def dynamic_baseline(series: DataFrame, folds: DataFrame, keys="sensor", pos: str = "pos",
                     ts: str = "ts", value: str = "value", period_s: int = 86400, slot_s: int = 3600,
                     threshold: float = 3.0, digits: int = 6) -> DataFrame:
    """Time-of-day baseline, retrained per walk-forward fold.

    fit: per (fold, key, slot of the period) mean / sample std / count of the
    fold's training window. score: z = (x - mean) / std on the fold's test
    rows (NULL when std is 0 or missing), kept when |z| >= threshold, else 0.
    A reading lands in at most ceil(window / wf) + 1 folds, so the join by
    range expands the data by a bounded factor. ``folds`` has (fold, role, lo,
    hi) rows for the whole table or for each key (``shape.series_folds``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    slot = F.floor(F.pmod(epoch_s(ts), F.lit(period_s)) / slot_s).cast("int")
    x = walk_forward(series.withColumn("slot", slot), folds, pos, keys)
    model = x.where("role = 'train'").groupBy("fold", *keys, "slot").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_train"))
    test = x.where("role = 'test'").drop("role")
    z = F.round(F.try_divide(F.col(value) - F.col("mean"), F.col("std")), digits)
    return (test.join(model, ["fold", *keys, "slot"], "left")
                .withColumn("z_raw", z)
                .withColumn("z", F.when(F.abs("z_raw") >= threshold, F.col("z_raw")).otherwise(F.lit(0.0)))
                .select("fold", *keys, ts, pos, value, F.round("mean", digits).alias("mean"),
                        F.round("std", digits).alias("std"), "n_train", "z"))


def quantile_table(train: DataFrame, keys, score: str, n_q: int = 999) -> DataFrame:
    """Per key the k/(n_q+1) quantiles of the training scores (one array row
    per key, n_q doubles), exact at every size."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    probs = [k / (n_q + 1) for k in range(1, n_q + 1)]
    return group_quantiles(train, keys, score, probs)


def calibrate(test: DataFrame, qtable: DataFrame, keys, score: str, n_q: int = 999,
              threshold: float = 3.0, digits: int = 6) -> DataFrame:
    """Score -> z via the empirical CDF of the training scores and the inverse
    normal: F = (#quantiles <= s + 0.5) / (n_q + 1), z = Phi^-1(F); z kept
    when |z| >= threshold else 0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    x = test.join(qtable, keys, "left")
    k = F.size(F.filter(F.transform("_q", lambda v: F.round(v, digits)), lambda v: v <= F.col(score)))
    p = (k.cast("double") + F.lit(0.5)) / F.lit(float(n_q + 1))
    x = x.withColumn("cdf", p).withColumn("z_raw", F.round(inv_norm(p), digits))
    return (x.withColumn("z", F.when(F.abs("z_raw") >= threshold, F.col("z_raw")).otherwise(F.lit(0.0)))
             .drop("_q"))


def forest_size(train: DataFrame, keys, value: str = "value", k: float = 3.0,
                base_trees: int = 128) -> DataFrame:
    """Adaptive random-cut forest size per group (the reference's rule):
    far = #below(median - 3 mad) + #above(median + 3 mad) + 1 with the mean
    absolute deviation; if far < 10 then far = int(0.005 n); samples =
    int(n / far); trees = 128; if int(n/128) <= samples <= int(n/64) then
    trees = int(n / samples); elif samples > int(n/64): samples 512, trees 64."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = (train.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(value).alias("n"))
              .join(group_median(train, keys, value, "_med"), keys, "left"))
    x = train.join(s, keys)
    mad = x.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("_mad"))
    b = s.join(mad, keys).withColumn("_lo", F.col("_med") - k * F.col("_mad")) \
         .withColumn("_hi", F.col("_med") + k * F.col("_mad"))
    cnt = (train.join(b.select(*keys, "_lo", "_hi"), keys)
                .groupBy(*keys).agg((F.sum(F.when(F.col(value) < F.col("_lo"), 1).otherwise(0))
                                     + F.sum(F.when(F.col(value) > F.col("_hi"), 1).otherwise(0)) + 1)
                                    .cast("long").alias("far0")))
    y = b.select(*keys, "n").join(cnt, keys)
    far = F.when(F.col("far0") < 10, F.floor(F.col("n") * 0.005)).otherwise(F.col("far0")).cast("long")
    far = F.greatest(far, F.lit(1))
    y = y.withColumn("far", far).withColumn("_s", F.floor(F.col("n") / F.col("far")).cast("long"))
    lo, hi = F.floor(F.col("n") / base_trees), F.floor(F.col("n") / 64)
    samples = F.when(F.col("_s") > hi, F.lit(512)).otherwise(F.col("_s"))
    trees = (F.when((F.col("_s") >= lo) & (F.col("_s") <= hi), F.floor(F.col("n") / F.col("_s")))
              .when(F.col("_s") > hi, F.lit(64)).otherwise(F.lit(base_trees)))
    return y.select(*keys, "n", "far", samples.cast("long").alias("samples"), trees.cast("long").alias("trees"))


# ------------------------------------------------------------ isolation forest
EULER = 0.5772156649


def _c(n):
    """Average path length of an unsuccessful search in a BST of n points."""
    import numpy as np
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree_leaves(values, seed: int):
    """One 1-D isolation tree on a bounded sample: leaves as value intervals
    [lo, hi), returned as (lower bounds, upper bounds, path lengths) sorted
    by (lo, hi). A
    cut that lands exactly on a sample value leaves empty intervals [a, a)
    next to [a, b); sorting by hi as well makes a lookup of a land on the
    non-empty one.

    The sample is sorted once; a node is an index range of it, so a split
    is a binary search instead of two array copies. Nodes are expanded
    depth-first, right child first, drawing one uniform cut per split."""
    import numpy as np
    rng = np.random.default_rng(int(seed) & 0x7FFFFFFF)
    pts = np.sort(np.asarray(values, dtype=float))
    limit = int(np.ceil(np.log2(max(len(pts), 2))))
    lows, highs, paths = [], [], []
    stack = [(-np.inf, np.inf, 0, len(pts), 0)]
    while stack:
        lo, hi, i, j, d = stack.pop()
        if d >= limit or j - i <= 1 or pts[i] == pts[j - 1]:
            lows.append(lo)
            highs.append(hi)
            paths.append(d + float(_c(j - i)))
            continue
        cut = rng.uniform(pts[i], pts[j - 1])
        k = i + int(np.searchsorted(pts[i:j], cut, side="left"))
        stack.append((lo, cut, i, k, d + 1))
        stack.append((cut, hi, k, j, d + 1))
    lows, highs, paths = np.asarray(lows), np.asarray(highs), np.asarray(paths)
    order = np.lexsort((highs, lows))
    return lows[order], highs[order], paths[order]
