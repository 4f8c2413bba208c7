"""Driver tables mapped onto the sensor domain (FIXTURES.md, "Mapping").

* ``readings``  <- events: sensor = event_type, value = value
* ``many-sensor readings`` <- events: sensor = user_id
* ``points``    <- events: measurement 'events', stamp 'Original', field = event_type
* ``machine``   <- lineitem joined with part, classes from derived rules
* ``series``    <- embeddings.embedding (fixed length 64), label for ARI

Every mapping is a lazy projection of a Parquet scan, so column pruning and
filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

# Fixed values of the mapping (shared with the oracle SQL in catalog.py).
TRUTH_THRESHOLD = 100.0   # event value above which a reading is a true anomaly
ALARM_THRESHOLD = 150.0   # detector stand-in: value above this raises an alarm
ALARM_LOW = 60.0          # ...and a second, noisy alarm source (false positives)
ALARM_USER_MOD = 5        # users with id % 5 == 0 alarm above ALARM_LOW


def readings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("sensor"), "ts", "value")


def user_readings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").cast("string").alias("sensor"), "ts", "value")


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """Per-event truth and alarm flags (1 = anomaly) used by the evaluators."""
    e = load(spark, d, "events")
    return e.select(
        F.col("event_type").alias("sensor"), "ts", "value",
        (F.col("value") > TRUTH_THRESHOLD).cast("int").alias("label"),
        ((F.col("value") > ALARM_THRESHOLD)
         | ((F.col("value") > ALARM_LOW) & (F.pmod("user_id", F.lit(ALARM_USER_MOD)) == 0)))
        .cast("int").alias("alarm"))


SCORED_EVENTS_SQL = f"""
  SELECT event_type AS sensor, ts, value,
         CAST(value > {TRUTH_THRESHOLD} AS INTEGER) AS label,
         CAST(value > {ALARM_THRESHOLD} OR (value > {ALARM_LOW} AND user_id % {ALARM_USER_MOD} = 0) AS INTEGER) AS alarm
  FROM events"""


def machine(spark: SparkSession, d: str) -> DataFrame:
    """AI4I-shaped machine table from lineitem joined with part.

    type = l_returnflag (A/N/R), torque and rpm from quantity and price,
    wear = 5 * p_size, temperatures from discount and tax; key =
    (l_orderkey, l_linenumber). Failure classes come from the reference's
    failure rules applied to these measures (``features.machine_failure``).
    The join is big-to-medium: part is keyed by p_partkey and the planner
    broadcasts it only when its measured size allows.
    """
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                            "l_linestatus", "l_quantity", "l_extendedprice",
                                            "l_discount", "l_tax")
    p = load(spark, d, "part").select("p_partkey", "p_size")
    x = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return x.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("type"),
        (F.lit(298.0) + F.col("l_discount") * 40).alias("air_k"),
        (F.lit(298.0) + F.col("l_discount") * 40 + F.lit(7.5) + F.col("l_tax") * 50).alias("process_k"),
        (F.lit(1150) + F.pmod(F.floor("l_extendedprice").cast("long"), F.lit(1750))).cast("int").alias("rpm"),
        (F.lit(15.0) + F.col("l_quantity") * 0.7).alias("torque"),
        (F.col("p_size") * 5).cast("int").alias("wear"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
         & (F.col("l_discount") == 0)).alias("random_fault"))


MACHINE_SQL = """
  SELECT l_orderkey, l_linenumber, l_returnflag AS type,
         298.0 + l_discount * 40 AS air_k,
         298.0 + l_discount * 40 + 7.5 + l_tax * 50 AS process_k,
         CAST(1150 + CAST(floor(l_extendedprice) AS BIGINT) % 1750 AS INTEGER) AS rpm,
         15.0 + l_quantity * 0.7 AS torque, CAST(p_size * 5 AS INTEGER) AS wear,
         (l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount = 0) AS random_fault
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def line_fault(spark: SparkSession, d: str) -> DataFrame:
    """Line-fault table: dummies G, C, B, A from l_linestatus and the bits of
    l_linenumber (all 16 patterns occur), six measures from the line."""
    li = load(spark, d, "lineitem")
    ln = F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_linestatus") == "F").cast("int").alias("g"),
        F.shiftright(ln, 2).bitwiseAND(F.lit(1)).alias("c"),
        F.shiftright(ln, 1).bitwiseAND(F.lit(1)).alias("b"),
        ln.bitwiseAND(F.lit(1)).alias("a"),
        F.col("l_quantity").alias("ia"), (F.col("l_extendedprice") / 1000).alias("ib"),
        (F.col("l_discount") * 100).alias("ic"), (F.col("l_tax") * 100).alias("va"),
        (F.col("l_quantity") * F.col("l_discount")).alias("vb"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("vc"))


def point_labels(spark: SparkSession, d: str, step: str = "1 hour") -> DataFrame:
    """Shared point truth per grid bin: 1 when the bin's count of `error`
    events exceeds the 0.9 quantile of those counts (scale-free)."""
    from ..operators.grid import resample
    err = (load(spark, d, "events").where(F.col("event_type") == "error")
           .select(F.lit("error").alias("sensor"), "ts", "value"))
    c = resample(err, step, "count", out="n")
    from ..functions.quantiles import group_quantiles
    c = c.withColumn("_one", F.lit(0))
    q = group_quantiles(c, "_one", "n", [0.9]).select("_one", F.col("_q")[0].alias("_q90"))
    return (c.join(F.broadcast(q), "_one")
             .select("ts", (F.col("n") > F.col("_q90")).cast("int").alias("label")))


def embedding_series(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-length series from the embeddings table: one group
    (sensor = 'embeddings'), chunk_id = vec_id, vals as ARRAY<DOUBLE>."""
    e = load(spark, d, "embeddings")
    return e.select(F.lit("embeddings").alias("sensor"), F.col("vec_id").alias("chunk_id"),
                    F.col("embedding").cast("array<double>").alias("vals"), "label")
