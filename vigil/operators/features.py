"""Supervised feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values from the machine failure description: power factor rpm -> rad/s,
# heat and power limits, overstrain limits by product quality, tool wear band.
RAD_PER_RPM = 0.10472
HEAT_LIMIT_K = 8.6
HEAT_RPM_LIMIT = 1380
POWER_MIN_W, POWER_MAX_W = 3500, 9000
OVERSTRAIN_LIMIT = {"L": 11000, "M": 12000, "H": 13000}
TOOL_WEAR_BAND = (200, 240)
# our machine table carries types A/N/R (lineitem flags) in place of L/M/H
TYPE_ALIAS = {"A": "L", "N": "M", "R": "H"}

FAILURE_NAMES = ["Heat Dissipation Failure", "No Failure", "Overstrain Failure",
                 "Power Failure", "Random Failures", "Tool Wear Failure"]


def machine_failure(df: DataFrame) -> DataFrame:
    """Label a machine table with the failure rules (first match wins):
    heat, power, overstrain, tool wear (with torque above 40), then random
    faults; ``target`` = 1 for any failure."""
    heat = F.abs(F.col("air_k") - F.col("process_k"))
    power = F.col("torque") * F.col("rpm") * F.lit(RAD_PER_RPM)
    strain = F.col("wear") * F.col("torque")
    limit = F.lit(None).cast("int")
    for t, q in TYPE_ALIAS.items():
        limit = F.when(F.col("type") == t, F.lit(OVERSTRAIN_LIMIT[q])).otherwise(limit)
    ft = (F.when((heat < HEAT_LIMIT_K) & (F.col("rpm") < HEAT_RPM_LIMIT), "Heat Dissipation Failure")
           .when((power < POWER_MIN_W) | (power > POWER_MAX_W), "Power Failure")
           .when(strain > limit, "Overstrain Failure")
           .when(F.col("wear").between(*TOOL_WEAR_BAND) & (F.col("torque") > 40), "Tool Wear Failure")
           .when(F.col("random_fault"), "Random Failures")
           .otherwise("No Failure"))
    return (df.withColumn("failure_type", ft)
              .withColumn("target", F.when(F.col("failure_type") == "No Failure", 0).otherwise(1))
              .drop("random_fault"))


def relabel_random(df: DataFrame) -> DataFrame:
    """Random failures become target 0 and class 'No Failure' (both decided
    from the original row)."""
    rnd = F.col("failure_type") == "Random Failures"
    return df.select(*[c for c in df.columns if c not in ("target", "failure_type")],
                     F.when(rnd, 0).otherwise(F.col("target")).alias("target"),
                     F.when(rnd, "No Failure").otherwise(F.col("failure_type")).alias("failure_type"))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Alphabetical codes 0..k-1 (``LabelEncoder``). The class list is
    computed as a distinct set, ranked, and broadcast (one row a class): a
    shuffle by class would put all rows of the commonest one into one task."""
    out = out or col
    classes = df.select(col).distinct()
    codes = classes.withColumn("_code", (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int"))
    j = df.join(F.broadcast(codes), col, "left")
    if out == col:
        return j.drop(col).withColumnRenamed("_code", col)
    return j.withColumnRenamed("_code", out)


def derive_features(df: DataFrame, encode: bool = True) -> DataFrame:
    """``pre_process_PM`` after relabelling: type and failure codes
    (alphabetical), heat = |air - process|, power = torque * rpm * 0.10472,
    overstrain = wear * torque; drops air and torque; fixed column order.
    ``encode=False`` keeps the class names (saves the two distinct passes
    when the codes are not used downstream)."""
    x = relabel_random(df)
    if encode:
        x = label_encode(x, "type")
        x = label_encode(x, "failure_type")
    x = (x.withColumn("heat", F.abs(F.col("air_k") - F.col("process_k")))
          .withColumn("power", F.col("torque") * (F.col("rpm") * F.lit(RAD_PER_RPM)))
          .withColumn("overstrain", F.col("wear") * F.col("torque")))
    keys = [c for c in ("l_orderkey", "l_linenumber") if c in x.columns]
    return x.select(*keys, "type", "power", "process_k", "heat", "wear", "overstrain", "rpm",
                    "target", "failure_type")


FEATURES = ["type", "power", "process_k", "heat", "wear", "overstrain", "rpm"]


def hash_unit(*keys) -> Column:
    """Deterministic pseudo-uniform [0, 1) from integer keys, reproducible in
    plain SQL: ((k1 % 1000003) * 2654435761 + k2 * 40503) % 2^32 / 2^32."""
    k1 = F.pmod(F.col(keys[0]).cast("long"), F.lit(1000003))
    h = k1 * F.lit(2654435761)
    if len(keys) > 1:
        h = h + F.pmod(F.col(keys[1]).cast("long"), F.lit(1000003)) * F.lit(40503)
    return F.pmod(h, F.lit(4294967296)) / F.lit(4294967296.0)


def hash_split(df: DataFrame, keys, test_share: float = 0.33) -> DataFrame:
    """Random split stable under repartitioning: a row is 'test' when the hash
    unit of its key is below ``test_share``."""
    return df.withColumn("split", F.when(hash_unit(*keys) < test_share, "test").otherwise("train"))


def minmax_scale(df: DataFrame, cols, split_col: str = "split", fit_on: str = "train",
                 digits: int | None = 6) -> DataFrame:
    """Min-max scaling fitted on the ``fit_on`` rows and applied to all rows;
    a constant column scales to 0. The fit is one aggregate row, broadcast."""
    cols = list(cols)
    st = (df.where(F.col(split_col) == fit_on)
            .agg(*[F.min(c).alias(f"_mn_{c}") for c in cols], *[F.max(c).alias(f"_mx_{c}") for c in cols])
            .withColumn("_k", F.lit(0)))
    x = df.withColumn("_k", F.lit(0)).join(F.broadcast(st), "_k").drop("_k")
    for c in cols:
        v = F.coalesce(F.try_divide(F.col(c) - F.col(f"_mn_{c}"), F.col(f"_mx_{c}") - F.col(f"_mn_{c}")),
                       F.lit(0.0))
        x = x.withColumn(c, F.round(v, digits) if digits is not None else v)
    return x.drop(*[f"_mn_{c}" for c in cols], *[f"_mx_{c}" for c in cols])
