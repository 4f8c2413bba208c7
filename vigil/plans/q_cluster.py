"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, shape, stats
from .domain import embedding_series
from .q_shape import hourly_filled
from .registry import query

EMB_SQL = "SELECT 'embeddings' AS sensor, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings"
SQD = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SEEDS_SQL = f"""
  e AS ({EMB_SQL}),
  c0 AS (SELECT sensor, arg_min(vals, chunk_id) AS v0 FROM e GROUP BY sensor),
  c1 AS (SELECT e.sensor, arg_max(e.vals, ({SQD.format(a='e.vals', b='c0.v0')}, -e.chunk_id)) AS v1
         FROM e JOIN c0 ON e.sensor = c0.sensor GROUP BY e.sensor),
  cs AS (SELECT c0.sensor, v0, v1 FROM c0 JOIN c1 ON c0.sensor = c1.sensor),
  a AS (SELECT e.sensor, e.chunk_id, e.vals, {SQD.format(a='e.vals', b='cs.v0')} AS d0,
               {SQD.format(a='e.vals', b='cs.v1')} AS d1 FROM e JOIN cs ON e.sensor = cs.sensor),
  asg AS (SELECT sensor, chunk_id, vals, CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster,
                 CASE WHEN d1 < d0 THEN d1 ELSE d0 END AS dist FROM a)"""


def _seeded(spark, d):
    s = embedding_series(spark, d).drop("label")
    cents = cluster.seed_centroids(s, "sensor", 2)
    return s, cents


# ---- item 68: nearest centroid per series (Euclidean) ----
@query("nearest_series", sql=f"""
WITH {SEEDS_SQL}
SELECT sensor, chunk_id, CAST(cluster AS INTEGER) AS cluster, round(dist, 6) AS dist FROM asg""")
def q_nearest_series(spark, d):
    s, cents = _seeded(spark, d)
    a = cluster.assign(s, cents, "sensor")
    return a.select("sensor", "chunk_id", "cluster", F.round("dist", 6).alias("dist"))


# ---- item 68: nearest centroid per series by DTW and by soft-DTW ----
@query("nearest_series_dtw")
def q_nearest_series_dtw(spark, d):
    s, cents = _seeded(spark, d)
    return cluster.dtw_assign(s, cents, "sensor").select("sensor", "chunk_id", "cluster", F.round("dist", 6).alias("dist"))


@query("nearest_series_softdtw")
def q_nearest_series_softdtw(spark, d):
    s, cents = _seeded(spark, d)
    s = s.join(F.broadcast(cluster.softdtw_gamma(s, "sensor")), "sensor")
    return cluster.softdtw_assign(s, cents, "sensor").select("sensor", "chunk_id", "cluster", F.round("dist", 6).alias("dist"))


# ---- item 64 (one step): assignment to the seeds, then the mean update ----
@query("kmeans_assign", sql=f"""
WITH {SEEDS_SQL},
ex AS (SELECT sensor, cluster, unnest(vals) AS x, generate_subscripts(vals, 1) AS i FROM asg),
m AS (SELECT sensor, cluster, i, avg(x) AS v FROM ex GROUP BY sensor, cluster, i),
n AS (SELECT sensor, cluster, count(*) AS n_members FROM asg GROUP BY sensor, cluster)
SELECT m.sensor, CAST(m.cluster AS INTEGER) AS cluster, n.n_members, list(round(v, 6) ORDER BY i) AS vals
FROM m JOIN n ON m.sensor = n.sensor AND m.cluster = n.cluster GROUP BY m.sensor, m.cluster, n.n_members""")
def q_kmeans_assign(spark, d):
    s, cents = _seeded(spark, d)
    a = cluster.assign(s, cents, "sensor")
    new = cluster.update(a, "sensor")
    n = a.groupBy("sensor", "cluster").agg(F.count(F.lit(1)).alias("n_members"))
    return new.join(n, ["sensor", "cluster"]).select(
        "sensor", "cluster", "n_members", F.transform("vals", lambda v: F.round(v, 6)).alias("vals"))


# ---- item 67: canonical labels (k = 2): swap when test cluster 0 is smaller ----
@query("canonical_labels", sql=f"""
WITH {SEEDS_SQL},
nn AS (SELECT count(*) AS n FROM e),
sp AS (SELECT asg.*, CASE WHEN chunk_id < floor(0.6 * nn.n) THEN 'train' ELSE 'test' END AS split FROM asg, nn),
sw AS (SELECT sensor, sum(CASE WHEN cluster = 0 THEN 1 ELSE 0 END) < sum(CASE WHEN cluster = 1 THEN 1 ELSE 0 END) AS swap
       FROM sp WHERE split = 'test' GROUP BY sensor)
SELECT sp.sensor, sp.chunk_id, sp.split,
       CAST(CASE WHEN coalesce(sw.swap, false) THEN 1 - sp.cluster ELSE sp.cluster END AS INTEGER) AS cluster
FROM sp LEFT JOIN sw ON sp.sensor = sw.sensor""")
def q_canonical_labels(spark, d):
    s, cents = _seeded(spark, d)
    a = cluster.assign(s, cents, "sensor")
    n = s.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    a = (a.withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k")
          .withColumn("split", F.when(F.col("chunk_id") < F.floor(F.lit(0.6) * F.col("_n")), "train")
                      .otherwise("test")).drop("_k", "_n"))
    tr, te, _ = cluster.canonical_labels(a.where(F.col("split") == "train"), a.where(F.col("split") == "test"),
                                         "sensor")
    return tr.unionByName(te).select("sensor", "chunk_id", "split", F.col("cluster").cast("int").alias("cluster"))


def _daily_chunks(spark, d):
    g = hourly_filled(spark, d)
    return shape.chunk_series(g, 24)


# ---- item 64: Euclidean k-means (k = 2, 5 iterations) on daily chunks of every sensor ----
@query("series_kmeans")
def q_series_kmeans(spark, d):
    s = _daily_chunks(spark, d)
    cents = cluster.kmeans(s, "sensor", 2, 5)
    a = cluster.assign(s, cents, "sensor")
    return a.select("sensor", "chunk_id", "start_ts", "cluster", F.round("dist", 6).alias("dist"))


# ---- item 65: DTW k-means with barycenter averaging (5 x 5 iterations) ----
@query("dtw_cluster")
def q_dtw_cluster(spark, d):
    s = _daily_chunks(spark, d)
    cents = cluster.dtw_kmeans(s, "sensor", 2, 5, 5)
    a = cluster.dtw_assign(s, cents, "sensor")
    return a.select("sensor", "chunk_id", "start_ts", "cluster", F.round("dist", 6).alias("dist"))


# ---- item 46 applied: ARI of the embedding clusters against the given labels ----
@query("cluster_ari")
def q_cluster_ari(spark, d):
    s = embedding_series(spark, d)
    cents = cluster.kmeans(s.drop("label"), "sensor", 2, 5)
    a = cluster.assign(s, cents, "sensor")
    return stats.adjusted_rand_index(a, "sensor", "label", "cluster")


# ---- item 31 (+45, 46): 12-hour chunks clustered (one step from the seeds),
# labels aligned to the padded cycle truth by key (cycle start), not position ----
CHUNK12_SQL = """
  WITH g AS ({hf}),
  c AS (SELECT sensor, pos // 12 AS chunk_id, min(ts) AS start_ts, count(*) AS n,
               list(round(v, 6) ORDER BY pos) AS vals FROM g GROUP BY sensor, pos // 12)
  SELECT sensor, chunk_id, start_ts, vals FROM c WHERE n = 12"""


def _cvt_sql():
    from .q_shape import HOURLY_FILLED_SQL, PAD_SQL
    e = CHUNK12_SQL.format(hf=HOURLY_FILLED_SQL)
    return f"""
WITH e AS ({e}),
c0 AS (SELECT sensor, arg_min(vals, chunk_id) AS v0 FROM e GROUP BY sensor),
c1 AS (SELECT e.sensor, arg_max(e.vals, ({SQD.format(a='e.vals', b='c0.v0')}, -e.chunk_id)) AS v1
       FROM e JOIN c0 ON e.sensor = c0.sensor GROUP BY e.sensor),
cs AS (SELECT c0.sensor, v0, v1 FROM c0 JOIN c1 ON c0.sensor = c1.sensor),
a AS (SELECT e.sensor, e.start_ts, {SQD.format(a='e.vals', b='cs.v0')} AS d0, {SQD.format(a='e.vals', b='cs.v1')} AS d1
      FROM e JOIN cs ON e.sensor = cs.sensor),
j AS (SELECT a.sensor, CAST(t.label AS INTEGER) AS label, CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster
      FROM a JOIN ({PAD_SQL}) t ON a.start_ts = t.cycle_start),
m AS (SELECT sensor, sum(CASE WHEN label = 1 AND cluster = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label <> 1 AND cluster = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND cluster <> 1 THEN 1 ELSE 0 END) AS fn FROM j GROUP BY sensor),
ct AS (SELECT sensor, label, cluster, count(*) AS nij FROM j GROUP BY ALL),
sa AS (SELECT sensor, sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sensor, label, sum(nij) AS ai FROM ct GROUP BY ALL) GROUP BY sensor),
sb AS (SELECT sensor, sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sensor, cluster, sum(nij) AS bj FROM ct GROUP BY ALL) GROUP BY sensor),
ss AS (SELECT sensor, sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM ct GROUP BY sensor),
x AS (SELECT ss.sensor, sij, sa.sa, sb.sb, sa.sa * sb.sb / (n * (n - 1) / 2.0) AS ex, (sa.sa + sb.sb) / 2 AS mx
      FROM ss JOIN sa ON ss.sensor = sa.sensor JOIN sb ON ss.sensor = sb.sensor)
SELECT m.sensor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
       round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) AS ari
FROM m JOIN x ON m.sensor = x.sensor"""


@query("cluster_vs_truth", sql=_cvt_sql())
def q_cluster_vs_truth(spark, d):
    from .q_shape import _padded
    g = hourly_filled(spark, d).withColumn("value", F.round("value", 6))
    s = shape.chunk_series(g, 12)
    a = cluster.assign(s, cluster.seed_centroids(s, "sensor", 2), "sensor")
    t = _padded(spark, d).select(F.col("cycle_start").alias("start_ts"), F.col("label").cast("int").alias("label"))
    j = a.join(t, "start_ts")
    m = stats.binary_metrics(j, "sensor", "label", "cluster").select("sensor", "tp", "fp", "fn", "precision",
                                                                    "recall", "f1")
    ari = stats.adjusted_rand_index(j, "sensor", "label", "cluster").select("sensor", "ari")
    return m.join(ari, "sensor")


# ---- item 66: soft-DTW k-means (gamma from the data, 5 x 5 iterations) ----
@query("softdtw_cluster")
def q_softdtw_cluster(spark, d):
    s = _daily_chunks(spark, d)
    cents = cluster.softdtw_kmeans(s, "sensor", 2, 5, 5)
    s2 = s.join(cluster.softdtw_gamma(s, "sensor"), "sensor")
    a = cluster.softdtw_assign(s2, cents, "sensor")
    return a.select("sensor", "chunk_id", "start_ts", "cluster", F.round("dist", 6).alias("dist"))
