"""k-means on fixed-length series.

Series rows: ``(keys, chunk_id, vals ARRAY<DOUBLE>)``. All series groups
(sensors) are clustered in one job. Centroids are a small table (k rows per
key); each assignment step joins it to the series by key as one array row and
picks the nearest centroid with array expressions (the row is broadcast: a
shuffle would put all series of a key into one task). The update step is an aggregate per
(key, cluster, index). The driver loop only swaps the centroid table, which
is checkpointed each iteration to keep lineage short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import StorageLevel

from . import warping
from ..functions.quantiles import group_median
from ..session import cut_lineage


def _keys(keys):
    """Series are always grouped by at least one key column (e.g. sensor);
    the centroid table is joined on it, never by a cartesian product."""
    k = [keys] if isinstance(keys, str) else list(keys or [])
    if not k:
        raise ValueError("clustering needs a key column (use a constant column for one group)")
    return k


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays (summed in index order)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def seed_centroids(series: DataFrame, keys, k: int = 2, id_col: str = "chunk_id") -> DataFrame:
    """Deterministic farthest-first seeding: the first series (smallest id),
    then repeatedly the series farthest from its nearest chosen centroid
    (ties: smallest id). k aggregate passes; no random state."""
    keys = _keys(keys)
    first = series.groupBy(*keys).agg(F.min_by("vals", id_col).alias("vals")).withColumn("cluster", F.lit(0))
    cents = first
    for c in range(1, k):
        arr = cents.groupBy(*keys).agg(F.collect_list("vals").alias("_cs"))
        x = series.join(F.broadcast(arr), keys)
        x = x.withColumn("_d", F.array_min(F.transform("_cs", lambda cv: sq_dist(cv, F.col("vals")))))
        nxt = (x.groupBy(*keys)
                .agg(F.max_by(F.col("vals"), F.struct(F.col("_d"), -F.col(id_col))).alias("vals"))
                .withColumn("cluster", F.lit(c)))
        cents = cents.unionByName(nxt)
    return cents.select(*keys, F.col("cluster").cast("int").alias("cluster"), "vals")


def assign(series: DataFrame, centroids: DataFrame, keys, dist_fn=None) -> DataFrame:
    """Nearest centroid per series: ``cluster`` and squared distance ``dist``
    (ties: smaller cluster id)."""
    keys = _keys(keys)
    arr = centroids.groupBy(*keys).agg(F.collect_list(F.struct("cluster", F.col("vals").alias("cv"))).alias("_cs"))
    x = series.join(F.broadcast(arr), keys)
    dist = dist_fn or (lambda c: sq_dist(c["cv"], F.col("vals")))
    best = F.array_min(F.transform("_cs", lambda c: F.struct(dist(c).alias("d"), c["cluster"].alias("cl"))))
    return x.withColumn("_b", best).select(*[c for c in series.columns], F.col("_b.cl").alias("cluster"),
                                           F.col("_b.d").alias("dist"))


def update(assigned: DataFrame, keys) -> DataFrame:
    """Mean series per (key, cluster): posexplode + avg per index."""
    keys = _keys(keys)
    e = assigned.select(*keys, "cluster", F.posexplode("vals").alias("idx", "v"))
    m = e.groupBy(*keys, "cluster", "idx").agg(F.avg("v").alias("v"))
    return (m.groupBy(*keys, "cluster")
             .agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_a"))
             .select(*keys, "cluster", F.transform("_a", lambda s: s["v"]).alias("vals")))


def swap_centroids(centroids: DataFrame, swap: DataFrame, keys) -> DataFrame:
    """Apply the same 0 <-> 1 relabelling to the centroid table (the
    reference leaves its centroids unswapped; we keep them consistent)."""
    keys = _keys(keys)
    x = centroids.join(swap, keys, "left")
    return x.withColumn("cluster", F.when(F.coalesce("swap", F.lit(False)), 1 - F.col("cluster"))
                        .otherwise(F.col("cluster"))).drop("swap")


def canonical_labels(train: DataFrame, test: DataFrame, keys, label: str = "cluster"):
    """k = 2: if cluster 0 has strictly fewer test members than cluster 1,
    swap 0 and 1 in train and test (ties keep). Returns (train, test, swap);
    ``swap_centroids`` applies the same swap to the centroid table."""
    keys = _keys(keys)
    cnt = test.groupBy(*keys).agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_n0"),
                                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_n1"))
    swap = cnt.select(*keys, (F.col("_n0") < F.col("_n1")).alias("swap"))

    def apply(df):
        x = df.join(F.broadcast(swap), keys, "left")
        return x.withColumn(label, F.when(F.coalesce("swap", F.lit(False)), 1 - F.col(label))
                            .otherwise(F.col(label))).drop("swap")
    return apply(train), apply(test), swap


def kmeans(series: DataFrame, keys, k: int = 2, max_iter: int = 5, dist_fn=None, update_fn=None,
           checkpoint: bool = True) -> DataFrame:
    """Lloyd iterations from farthest-first seeds; returns the centroid table."""
    keys = _keys(keys)
    # the series are read every iteration: keep them on the executors
    series = series.persist(StorageLevel.MEMORY_AND_DISK)
    cents = cut_lineage(seed_centroids(series, keys, k))
    for _ in range(max_iter):
        a = assign(series, cents, keys, dist_fn)
        new = (update_fn or update)(a, keys)
        # clusters that lost all members keep their previous centroid
        new = cents.join(new.withColumnRenamed("vals", "_nv"), [*keys, "cluster"], "left") \
                   .select(*keys, "cluster", F.coalesce("_nv", "vals").alias("vals"))
        cents = cut_lineage(new) if checkpoint else new
    return cents


# ------------------------------------------------------------------ DTW
def _alike(values):
    """(indices, value) of equal values: the rows of a batch that are measured
    against the same centroids."""
    groups: dict[bytes, list[int]] = {}
    for i, v in enumerate(values):
        groups.setdefault(b"".join(np.asarray(c, float).tobytes() + b"|" for c in v), []).append(i)
    return [(at, [np.asarray(c, float) for c in values.iloc[at[0]]]) for at in groups.values()]


def _blocks(values, at, others):
    """Equally long series of the rows ``at``, in blocks that fit the tables of
    the longest of ``others``."""
    own = [np.asarray(values.iloc[i], float) for i in at]
    for index, x in warping.by_length(own, other=max([1, *(len(c) for c in others)])):
        yield [at[i] for i in index], x


NEAREST_T = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("dist", T.DoubleType())])


@F.pandas_udf(NEAREST_T)
def dtw_nearest(vals: pd.Series, cents: pd.Series) -> pd.DataFrame:
    """Per series the nearest of its centroids by DTW, whole batches at once;
    centroids whose envelope bound is too far are not measured."""
    at, dist = np.zeros(len(vals), np.int32), np.zeros(len(vals))
    for rows, cs in _alike(cents):
        for own, x in _blocks(vals, rows, cs):
            at[own], dist[own], _ = warping.nearest(cs, x)
    return pd.DataFrame({"at": at, "dist": dist})


ALIGN_T = T.StructType([T.StructField("s", T.ArrayType(T.DoubleType())),
                        T.StructField("n", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(ALIGN_T)
def dtw_align(vals: pd.Series, cent: pd.Series) -> pd.DataFrame:
    sums, counts = [None] * len(vals), [None] * len(vals)
    for rows, (c,) in _alike(cent.map(lambda v: [v])):
        for own, x in _blocks(vals, rows, [c]):
            for i, s, n in zip(own, *warping.align(c, x), strict=True):
                sums[i], counts[i] = s.tolist(), n.tolist()
    return pd.DataFrame({"s": sums, "n": counts})


def _nearest_by(series: DataFrame, centroids: DataFrame, keys, found) -> DataFrame:
    """``series`` with cluster and dist of its key's nearest centroid.
    The centroids are k arrays a key, broadcast."""
    arr = centroids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cluster", "vals"))).alias("_cs"))
    x = series.join(F.broadcast(arr), keys).withColumn("_b", found)
    return x.select(*series.columns, F.element_at("_cs", F.col("_b.at") + 1)["cluster"].alias("cluster"), F.col("_b.dist").alias("dist"))


def dtw_assign(series: DataFrame, centroids: DataFrame, keys) -> DataFrame:
    return _nearest_by(series, centroids, _keys(keys), dtw_nearest(F.col("vals"), F.transform("_cs", lambda c: c["vals"])))


def dba_update(assigned: DataFrame, centroids: DataFrame, keys, inner_iter: int = 5) -> DataFrame:
    """DTW barycenter averaging: each executor aligns its series to the
    current centroid and emits per-index sums and counts; the sums are
    aggregated per (key, cluster, index). Repeated ``inner_iter`` times."""
    keys = _keys(keys)
    cents = centroids
    for _ in range(inner_iter):
        x = assigned.join(F.broadcast(cents.withColumnRenamed("vals", "_c")), [*keys, "cluster"])
        x = x.withColumn("_al", dtw_align(F.col("vals"), F.col("_c")))
        e = x.select(*keys, "cluster", F.posexplode(F.arrays_zip("_al.s", "_al.n")).alias("idx", "p"))
        agg = e.groupBy(*keys, "cluster", "idx").agg(F.sum("p.s").alias("s"), F.sum("p.n").alias("n"))
        new = (agg.groupBy(*keys, "cluster")
                  .agg(F.sort_array(F.collect_list(F.struct("idx", (F.col("s") / F.col("n")).alias("v")))).alias("_a"))
                  .select(*keys, "cluster", F.transform("_a", lambda s: s["v"]).alias("vals")))
        cents = cut_lineage(cents.join(new.withColumnRenamed("vals", "_nv"), [*keys, "cluster"], "left")
                                 .select(*keys, "cluster", F.coalesce("_nv", "vals").alias("vals")))
    return cents


def dtw_kmeans(series: DataFrame, keys, k: int = 2, max_iter: int = 5, inner_iter: int = 5) -> DataFrame:
    keys = _keys(keys)
    series = series.persist(StorageLevel.MEMORY_AND_DISK)
    cents = cut_lineage(seed_centroids(series, keys, k))
    for _ in range(max_iter):
        a = dtw_assign(series, cents, keys).persist(StorageLevel.MEMORY_AND_DISK)
        cents = dba_update(a, cents, keys, inner_iter)
        a.unpersist()
    return cents


# ------------------------------------------------------------------ soft-DTW
@F.pandas_udf(NEAREST_T)
def softdtw_nearest(vals: pd.Series, cents: pd.Series, gamma: pd.Series) -> pd.DataFrame:
    """Per series the centroid with the least soft-DTW value, ties to the first
    (soft-DTW may be negative, so no bound can skip one)."""
    at, dist = np.zeros(len(vals), np.int32), np.zeros(len(vals))
    g = gamma.to_numpy(float)
    for rows, cs in _alike(cents):
        for own, x in _blocks(vals, rows, cs):
            d = np.stack([warping.soft_costs(c, x, g[own])[0] for c in cs], axis=1)
            at[own], dist[own] = d.argmin(axis=1), d.min(axis=1)
    return pd.DataFrame({"at": at, "dist": dist})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def softdtw_grad(vals: pd.Series, cent: pd.Series, gamma: pd.Series) -> pd.Series:
    out, g = [None] * len(vals), gamma.to_numpy(float)
    for rows, (c,) in _alike(cent.map(lambda v: [v])):
        for own, x in _blocks(vals, rows, [c]):
            for i, grad in zip(own, warping.soft_costs(c, x, g[own], True)[1], strict=True):
                out[i] = grad.tolist()
    return pd.Series(out)


def softdtw_gamma(series: DataFrame, keys, buckets: int = 64) -> DataFrame:
    """Smoothing per key: 2 * sigma^2 with sigma = median distance of two
    points * sqrt(length). Every point meets one other point, its neighbour in
    hash order within a hash bucket, so no pairs are enumerated."""
    keys = _keys(keys)
    points = (series.select(*keys, F.size("vals").alias("_len"), F.xxhash64("vals").alias("_s"), F.posexplode("vals").alias("_p", "_x"))
                    .withColumn("_h", F.xxhash64("_s", "_p")).withColumn("_bkt", F.pmod("_h", F.lit(buckets))))
    w = Window.partitionBy(*keys, "_bkt").orderBy("_h")
    apart = points.withColumn("_d", F.abs(F.col("_x") - F.lead("_x").over(w)))
    size = series.groupBy(*keys).agg(F.max(F.size("vals")).alias("_len"))
    return (group_median(apart, keys, "_d", "_md").join(size, keys)
            .select(*keys, (2 * F.pow(F.col("_md"), 2) * F.col("_len")).alias("gamma")))


def softdtw_assign(series: DataFrame, centroids: DataFrame, keys) -> DataFrame:
    """``series`` has its key's smoothing in column gamma."""
    return _nearest_by(series, centroids, _keys(keys), softdtw_nearest(F.col("vals"), F.transform("_cs", lambda c: c["vals"]), F.col("gamma")))


def softdtw_update(assigned: DataFrame, centroids: DataFrame, keys, inner_iter: int = 5,
                   step: float = 0.5) -> DataFrame:
    """Barycenter by fixed-step gradient descent: every executor emits the
    gradient of soft-DTW(centroid, series) for its series; gradients are
    averaged per (key, cluster, index) and the centroid moves against them."""
    keys = _keys(keys)
    cents = centroids
    for _ in range(inner_iter):
        x = assigned.join(F.broadcast(cents.withColumnRenamed("vals", "_c")), [*keys, "cluster"])
        x = x.withColumn("_g", softdtw_grad(F.col("vals"), F.col("_c"), F.col("gamma")))
        e = x.select(*keys, "cluster", F.posexplode("_g").alias("idx", "g"))
        g = e.groupBy(*keys, "cluster", "idx").agg(F.avg("g").alias("g"))
        c = cents.select(*keys, "cluster", F.posexplode("vals").alias("idx", "v"))
        new = (c.join(g, [*keys, "cluster", "idx"], "left")
                .withColumn("v", F.col("v") - F.lit(step / 2.0) * F.coalesce("g", F.lit(0.0)))
                .groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_a"))
                .select(*keys, "cluster", F.transform("_a", lambda s: s["v"]).alias("vals")))
        cents = cut_lineage(new)
    return cents


def softdtw_kmeans(series: DataFrame, keys, k: int = 2, max_iter: int = 5, inner_iter: int = 5) -> DataFrame:
    keys = _keys(keys)
    series = series.join(F.broadcast(softdtw_gamma(series, keys)), keys).persist(StorageLevel.MEMORY_AND_DISK)
    cents = cut_lineage(seed_centroids(series, keys, k))
    for _ in range(max_iter):
        a = softdtw_assign(series, cents, keys).persist(StorageLevel.MEMORY_AND_DISK)
        cents = softdtw_update(a, cents, keys, inner_iter)
        a.unpersist()
    return cents
