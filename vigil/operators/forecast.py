"""Additive trend + seasonality forecaster.

Re-aimed as a distributed ridge regression: the design columns (intercept,
linear trend, hinge changepoints in the first 80 % of the window, weekly and
daily Fourier terms) are column expressions of time. The normal equations
X'X and X'y of each (fold, sensor) are one aggregate pass (d(d+1)/2 sums);
the small d x d solve runs per group in ``applyInPandas`` (one row in, one
row out); the forecast is a dot product with the joined coefficients.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_s
from . import stats
from .shape import walk_forward


def design(ts: str, t_days: Column, window_days: Column, n_changepoints: int = 5,
           weekly: int = 3, daily: int = 3) -> tuple[Column, int]:
    """Design row as ARRAY<DOUBLE> and its width."""
    cols = [F.lit(1.0), t_days]
    for j in range(1, n_changepoints + 1):
        cols.append(F.greatest(t_days - window_days * F.lit(0.8 * j / (n_changepoints + 1)), F.lit(0.0)))
    e = epoch_s(ts).cast("double")
    for k in range(1, weekly + 1):
        a = e * F.lit(2 * math.pi * k / (7 * 86400))
        cols += [F.sin(a), F.cos(a)]
    for k in range(1, daily + 1):
        a = e * F.lit(2 * math.pi * k / 86400)
        cols += [F.sin(a), F.cos(a)]
    return F.array(*cols), len(cols)


def normal_equations(train: DataFrame, keys, x: str = "x", y: str = "value", d: int = 0) -> DataFrame:
    keys = list(keys)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(d):
        aggs.append(F.sum(F.col(x)[i] * F.col(y)).alias(f"b{i}"))
        for j in range(i, d):
            aggs.append(F.sum(F.col(x)[i] * F.col(x)[j]).alias(f"a{i}_{j}"))
    return train.groupBy(*keys).agg(*aggs)


def _solver(d: int, keys, ridge: float, hinge_ridge: float, n_cp: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            a = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    a[i, j] = a[j, i] = r[f"a{i}_{j}"]
            b = np.array([r[f"b{i}"] for i in range(d)])
            pen = np.full(d, ridge)
            pen[0] = 0.0
            pen[2:2 + n_cp] = hinge_ridge
            coef = np.linalg.solve(a + np.diag(pen * max(r["n"], 1)), b)
            out.append({**{k: r[k] for k in keys}, "coef": coef.tolist()})
        return pd.DataFrame(out)
    return solve


def fit(train: DataFrame, keys, d: int, n_cp: int, ridge: float = 1e-4, hinge_ridge: float = 0.05,
        key_schema: str = "fold int, sensor string") -> DataFrame:
    """Coefficients per group; the changepoint prior maps to the ridge weight
    on the hinge columns."""
    keys = list(keys)
    ne = normal_equations(train, keys, d=d)
    return ne.groupBy(*keys).applyInPandas(_solver(d, keys, ridge, hinge_ridge, n_cp),
                                           f"{key_schema}, coef array<double>")


def predict(df: DataFrame, coefs: DataFrame, keys, x: str = "x") -> DataFrame:
    keys = list(keys)
    dot = F.aggregate(F.zip_with(x, "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(coefs, keys).withColumn("yhat", dot).drop("coef")


def walk_forward_forecast(series: DataFrame, folds: DataFrame, step_s: int, n_cp: int = 5, daily: bool = True) -> DataFrame:
    """Fit per (fold, sensor) on the fold's training rows, predict all rows of
    the fold (train and test). ``folds`` has (sensor, fold, role, lo, hi) with
    roles train/test (see ``shape.series_folds``); time counts from the start
    of a fold's training window and changepoints lie in its first 80 %."""
    window = folds.where(F.col("role") == "train").select("sensor", "fold", F.col("lo").alias("_t0"), (F.col("hi") - F.col("lo")).alias("_len"))
    x = walk_forward(series, folds.join(window, ["sensor", "fold"]))
    days = step_s / 86400.0
    arr, d = design("ts", (F.col("pos") - F.col("_t0")).cast("double") * F.lit(days), F.col("_len") * F.lit(days), n_cp, 3, 3 if daily else 0)
    x = x.withColumn("x", arr)
    coefs = fit(x.where(F.col("role") == "train"), ["fold", "sensor"], d, n_cp)
    return predict(x, coefs, ["fold", "sensor"]).withColumn("resid", F.col("value") - F.col("yhat")).drop("x", "_t0", "_len")


def residual_fence(pred: DataFrame, k: float = 3.0) -> DataFrame:
    """IQR fence fitted on the train residuals, applied to the test residuals."""
    tr = pred.where(F.col("role") == "train")
    te = pred.where(F.col("role") == "test")
    return stats.iqr_fence(te, ["fold", "sensor"], "resid", k, fit=tr)


def residual_z(pred: DataFrame, threshold: float = 3.0) -> DataFrame:
    """z = test residual / std of the train residuals; kept when |z| >= thr."""
    sd = pred.where(F.col("role") == "train").groupBy("fold", "sensor").agg(F.stddev_samp("resid").alias("_sd"))
    te = pred.where(F.col("role") == "test").join(sd, ["fold", "sensor"], "left")
    z = F.round(F.try_divide(F.col("resid"), F.col("_sd")), 6)
    return te.withColumn("z", F.when(F.abs(z) >= threshold, z).otherwise(F.lit(0.0))).drop("_sd")
