"""Aggregations and statistics.

All of these are one or two hash aggregates with map-side partial aggregation;
per-group statistic tables they produce are small (one row per sensor/model/
class) and are joined back by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import group_median, group_quantiles


def _ratio(a, b) -> Column:
    """a / b with 0 when b is 0 (the reference's zero_division=0)."""
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a,
                                   F.col(b) if isinstance(b, str) else b), F.lit(0.0)).cast("double")


# ---------------------------------------------------------------- item 39
def profile(df: DataFrame, columns=None) -> DataFrame:
    """One pass: rows, non-null count and any-null flag per column (long)."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(columns)]
    one = df.agg(*aggs)
    stack = "stack({n}, {body}) AS (column_name, n_non_null)".format(
        n=len(columns), body=", ".join(f"'{c}', _c{i}" for i, c in enumerate(columns)))
    return (one.selectExpr("_n AS n_rows", stack)
               .select("column_name", "n_rows", "n_non_null",
                       (F.col("n_rows") > F.col("n_non_null")).alias("has_null")))


# ---------------------------------------------------------------- item 40
def nunique(df: DataFrame, columns=None, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct count per column, long format. ``approx`` uses HyperLogLog++
    (one pass, fixed memory per column) for very large tables."""
    columns = list(columns or df.columns)
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    one = df.agg(*[fn(F.col(c)).cast("long").alias(f"_d{i}") for i, c in enumerate(columns)])
    stack = "stack({n}, {body}) AS (column_name, n_distinct)".format(
        n=len(columns), body=", ".join(f"'{c}', _d{i}" for i, c in enumerate(columns)))
    return one.selectExpr(stack)


# ---------------------------------------------------------------- item 41
def class_freq(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- item 42
def corr_matrix(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete), long format
    ``(col_a, col_b, corr)``.

    One pass: a generator in the scan stage turns each row into its
    d(d+1)/2 upper-triangle pairs ``(i, j, x, y)`` and ``corr`` is aggregated
    per pair, combined map-side, so the shuffle carries one partial row per
    pair and partition. A single aggregate with d(d+1)/2 ``corr`` buffers
    would do the same arithmetic but its generated update method grows past
    what the JIT compiles, which made it 2-3x slower. The symmetric lower half
    is mirrored from the upper rows after the aggregate."""
    columns = list(columns)
    n = len(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                               F.col(columns[i]).cast("double").alias("x"),
                               F.col(columns[j]).cast("double").alias("y"))
                      for i in range(n) for j in range(i, n)])
    upper = df.select(F.inline(pairs)).groupBy("i", "j").agg(F.corr("x", "y").alias("corr"))
    both = upper.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "corr")))
                                  .otherwise(F.array(F.struct("i", "j", "corr"),
                                                     F.struct(F.col("j").alias("i"), F.col("i").alias("j"),
                                                              "corr")))).alias("p"))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(F.element_at(names, F.col("p.i") + 1).alias("col_a"),
                       F.element_at(names, F.col("p.j") + 1).alias("col_b"),
                       F.round("p.corr", digits).alias("corr"))


# ---------------------------------------------------------------- item 43
def feat_prob(df: DataFrame, feature, target: str = "target", buckets: int = 1024) -> DataFrame:
    """For every feature in ``feature`` (a name or a list) and every distinct
    value j of it: 100 * mean(target) over rows with feature >= j, half-even
    rounded to 2 decimals; rows ``(feature, value, prob)``.

    The reference rescans the table per distinct value (O(d*n)). Here: one
    pass turns each row into its (feature, value) pairs and aggregates per
    pair (sum, count); then exact suffix sums by a two-level scan per
    feature: the distinct values are cut into ``buckets`` ranges at sketch
    quantiles (balanced even for skewed features), each range gets an
    in-range running sum, and a window over the (at most ``buckets``) range
    totals supplies the offsets. No task sees all distinct values, and the
    input is read once for all features.
    """
    feats = [feature] if isinstance(feature, str) else list(feature)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in feats])
    per = (df.select(F.col(target).cast("long").alias("_t"), F.inline(pairs))
             .groupBy("feature", "value")
             .agg(F.sum("_t").alias("_s"), F.count(F.lit(1)).alias("_n")))
    probs = [k / buckets for k in range(1, buckets)]
    cuts = per.groupBy("feature").agg(
        F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), 10000).alias("_cuts"))
    x = per.join(F.broadcast(cuts), "feature")  # one row per feature
    x = x.withColumn("_bk", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("value")))).drop("_cuts")
    # suffix sums in descending value order: in-range part + all higher ranges
    w_in = (Window.partitionBy("feature", "_bk").orderBy(F.col("value").desc())
                  .rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_cs", F.sum("_s").over(w_in)).withColumn("_cn", F.sum("_n").over(w_in))
    tot = x.groupBy("feature", "_bk").agg(F.sum("_s").alias("_bs"), F.sum("_n").alias("_bn"))
    # <= buckets rows per feature
    w_b = Window.partitionBy("feature").orderBy(F.col("_bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("_os", F.coalesce(F.sum("_bs").over(w_b), F.lit(0)))
              .withColumn("_on", F.coalesce(F.sum("_bn").over(w_b), F.lit(0))))
    x = x.join(F.broadcast(tot.select("feature", "_bk", "_os", "_on")), ["feature", "_bk"])
    return x.select("feature", "value",
                    F.bround((F.col("_cs") + F.col("_os")) / (F.col("_cn") + F.col("_on")) * 100, 2)
                    .alias("prob"))


# ---------------------------------------------------------------- item 44
def iqr_bounds(df: DataFrame, keys, value: str, k: float = 3.0, digits: int | None = 6) -> DataFrame:
    """Per key: q1, q3 (linear interpolation) and the fences q1-k*IQR, q3+k*IQR.
    Exact at every size (``functions.quantiles``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    q = group_quantiles(df, keys, value, [0.25, 0.75])
    q = q.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    q = (q.withColumn("lower", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1")))
          .withColumn("upper", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))))
    if digits is not None:
        for c in ("q1", "q3", "lower", "upper"):
            q = q.withColumn(c, F.round(c, digits))
    return q


def iqr_flag(value: Column, lower: Column, upper: Column, null_is_anomaly: bool = False) -> Column:
    """1 where value <= lower or value >= upper (fences inclusive)."""
    f = F.when((value <= lower) | (value >= upper), 1).otherwise(0)
    if null_is_anomaly:
        f = F.when(value.isNull(), 1).otherwise(f)
    return f.cast("int")


def iqr_fence(df: DataFrame, keys, value: str, k: float = 3.0, out: str = "flag",
              fit: DataFrame | None = None, digits: int | None = 6) -> DataFrame:
    """Flag outliers of ``value``; the fences are fitted on ``fit`` (default:
    the same rows) per key and joined back (one small row per key)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    b = iqr_bounds(fit if fit is not None else df, keys, value, k, digits)
    v = F.round(value, digits) if digits is not None else F.col(value)
    return (df.join(b.select(*keys, "lower", "upper"), on=keys, how="left")
              .withColumn(out, iqr_flag(v, F.col("lower"), F.col("upper"))))


# ---------------------------------------------------------------- item 45 / 52
def binary_counts(df: DataFrame, keys, truth: str, pred: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.sum(F.when(t & p, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~t & p, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(t & ~p, 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(t, 1).otherwise(0)).cast("long").alias("n_true"),
        F.sum(F.when(p, 1).otherwise(0)).cast("long").alias("n_pred"))


def prf(df: DataFrame, tp="tp", fp="fp", fn="fn", digits: int | None = 6) -> DataFrame:
    """precision, recall, F1 from counts; 0 on a zero denominator."""
    x = (df.withColumn("precision", _ratio(F.col(tp), F.col(tp) + F.col(fp)))
           .withColumn("recall", _ratio(F.col(tp), F.col(tp) + F.col(fn)))
           .withColumn("f1", _ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))))
    if digits is not None:
        for c in ("precision", "recall", "f1"):
            x = x.withColumn(c, F.round(c, digits))
    return x


def binary_metrics(df: DataFrame, keys, truth: str, pred: str, digits: int | None = 6) -> DataFrame:
    return prf(binary_counts(df, keys, truth, pred), digits=digits)


# ---------------------------------------------------------------- item 46
def adjusted_rand_index(df: DataFrame, keys, truth: str, pred: str) -> DataFrame:
    """ARI per key from the contingency table (one groupBy, then sums)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    c2 = lambda n: n * (n - 1) / 2.0
    cont = df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("nij"))
    a = cont.groupBy(*keys, truth).agg(F.sum("nij").alias("ai")).groupBy(*keys).agg(
        F.sum(c2(F.col("ai"))).alias("sa"))
    b = cont.groupBy(*keys, pred).agg(F.sum("nij").alias("bj")).groupBy(*keys).agg(
        F.sum(c2(F.col("bj"))).alias("sb"))
    s = cont.groupBy(*keys).agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    x = s.join(a, keys).join(b, keys)
    exp = F.col("sa") * F.col("sb") / c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp))
    return x.select(*keys, F.col("n").cast("long").alias("n"), F.round(ari, 6).alias("ari"))


# ---------------------------------------------------------------- items 47, 48
def class_counts(df: DataFrame, truth: str, pred: str, keys=()) -> DataFrame:
    """Per class: tp, fp, fn, support, predicted count (classes of truth or pred)."""
    keys = list(keys)
    n, zero = F.col("n"), F.lit(0).cast("long")
    pairs = df.groupBy(*[F.col(k) for k in keys], F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    # the rows are read once: a pair counts for its true and its predicted class;
    # null keys and classes equal nothing, so each side keeps its own
    known = F.forall(F.array(F.lit(True), *[F.col(k).isNotNull() for k in keys]), lambda v: v)
    side = lambda c, i: F.when(F.col(c).isNull() | ~known, i)
    sides = F.array(F.struct(F.col("_t").alias("cls"), side("_t", 0).alias("_side"), n.alias("support"), zero.alias("predicted"),
                             F.when(known & (F.col("_t") == F.col("_p")), n).otherwise(zero).alias("tp")),
                    F.struct(F.col("_p").alias("cls"), side("_p", 1).alias("_side"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))
    x = (pairs.select(*keys, F.inline(sides)).groupBy(*keys, "cls", "_side")
         .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]).drop("_side"))
    return (x.withColumn("fp", F.col("predicted") - F.col("tp"))
             .withColumn("fn", F.col("support") - F.col("tp")))


def multiclass_metrics(df: DataFrame, truth: str, pred: str, keys=()) -> DataFrame:
    """Micro and macro precision/recall/F1 and balanced accuracy (mean recall
    over classes present in the truth), x100, half-even rounded to 2 places.
    Macro averages run over the union of true and predicted labels."""
    keys = list(keys)
    c = class_counts(df, truth, pred, keys)
    c = (c.withColumn("p", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
          .withColumn("r", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
          .withColumn("f", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    agg = c.groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("balanced_accuracy"))
    agg = (agg.withColumn("micro_precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
              .withColumn("micro_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
              .withColumn("micro_f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    cols = ["micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall",
            "macro_f1", "balanced_accuracy"]
    return agg.select(*keys, *[F.bround(F.col(m) * 100, 2).alias(m) for m in cols])


def confusion(df: DataFrame, truth: str, pred: str, labels: DataFrame | None = None) -> DataFrame:
    """Dense confusion matrix, long: every (actual, predicted) pair over the
    label set (union of truth and prediction unless given), zero-filled."""
    pairs = df.groupBy(F.col(truth).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    if labels is None:
        # every label occurs in some (actual, predicted) pair: read it from
        # the pair counts instead of scanning the input twice more
        labels = pairs.select(F.explode(F.array("actual", "predicted")).alias("label"))
    # the label set is the class list (bounded by the number of classes):
    # one array row, exploded twice into the dense (actual, predicted) grid
    grid = (labels.agg(F.collect_set("label").alias("_l"))
                  .select(F.explode("_l").alias("actual"), "_l")
                  .select("actual", F.explode("_l").alias("predicted")))
    return (grid.join(pairs, ["actual", "predicted"], "left")
                .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------- item 49
def false_alarm_pct(df: DataFrame, keys, z: str = "z", nan_is_alarm: bool = True) -> DataFrame:
    """100 * share of rows with z != 0 per key (a missing z counts as an
    alarm, as NaN != 0 does in the reference)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    alarm = (F.col(z) != 0) if not nan_is_alarm else (F.col(z).isNull() | (F.col(z) != 0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(alarm, 1.0).otherwise(0.0)) * 100, 6).alias("false_alarm_pct"))


# ---------------------------------------------------------------- item 50
def mad_bounds(df: DataFrame, keys, value: str, k: float = 3.0, kind: str = "mean") -> DataFrame:
    """median +- k * spread and counts of rows strictly outside.

    ``kind='mean'``: mean absolute deviation about the mean (pandas ``.mad()``,
    the reference's behaviour); ``kind='median'``: median absolute deviation.
    Two aggregate passes joined by key; the per-key statistics are tiny.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = (df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
           .join(group_median(df, keys, value, "median"), keys, "left"))
    x = df.join(s, keys)
    if kind == "mean":
        dev = x.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("mean"))).alias("spread"))
    else:
        dev = group_median(x, keys, F.abs(F.col(value) - F.col("median")), "spread")
    b = (s.join(dev, keys)
          .withColumn("lower", F.round(F.col("median") - k * F.col("spread"), 6))
          .withColumn("upper", F.round(F.col("median") + k * F.col("spread"), 6)))
    v = F.round(F.col(value), 6)
    cnt = (df.join(b.select(*keys, "lower", "upper"), keys)
             .groupBy(*keys).agg(F.sum(F.when(v < F.col("lower"), 1).otherwise(0)).cast("long").alias("n_low"),
                                 F.sum(F.when(v > F.col("upper"), 1).otherwise(0)).cast("long").alias("n_high")))
    return (b.join(cnt, keys)
             .select(*keys, F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"),
                     "lower", "upper", "n_low", "n_high", F.col("n").cast("long").alias("n")))


# ---------------------------------------------------------------- item 51
def forecast_error(df: DataFrame, keys, actual: str, forecast: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    e2 = F.pow(F.col(actual) - F.col(forecast), 2)
    return (df.groupBy(*keys).agg(F.avg(e2).alias("mse"), F.count(e2).alias("n"))
              .select(*keys, "n", F.round("mse", 6).alias("mse"), F.round(F.sqrt("mse"), 6).alias("rmse")))


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
