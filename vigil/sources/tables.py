"""Parquet/CSV scans with explicit schemas.

Scans are lazy: Catalyst prunes columns (``ReadSchema``) and pushes filters
(``PushedFilters``) into the Parquet reader, so callers select and filter
after ``load`` without paying for unused columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_session

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session(spark)
    return spark.read.parquet(table_path(sf_dir, name))


# Schemas of the reference's CSV inputs (see FIXTURES.md, group A).
def pump_wide_schema(n_sensors: int = 52) -> T.StructType:
    fields = [T.StructField("row_id", T.IntegerType()),
              T.StructField("timestamp", T.StringType())]
    fields += [T.StructField(f"sensor_{i:02d}", T.DoubleType()) for i in range(n_sensors)]
    fields.append(T.StructField("machine_status", T.StringType()))
    return T.StructType(fields)


MACHINE_SCHEMA = T.StructType([
    T.StructField("udi", T.IntegerType()), T.StructField("product_id", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("air_k", T.DoubleType()),
    T.StructField("process_k", T.DoubleType()), T.StructField("rpm", T.IntegerType()),
    T.StructField("torque", T.DoubleType()), T.StructField("wear", T.IntegerType()),
    T.StructField("target", T.IntegerType()), T.StructField("failure_type", T.StringType()),
])

LINE_FAULT_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("g", "c", "b", "a")]
    + [T.StructField(c, T.DoubleType()) for c in ("ia", "ib", "ic", "va", "vb", "vc")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data)."""
    ensure_session(spark)
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def wide_to_readings(df, ts_col: str = "timestamp", ts_format: str | None = None,
                     status_col: str | None = "machine_status", drop=("row_id",)):
    """Wide sensor frame (one column per sensor) -> long ``readings``.

    The text timestamp is parsed once (``to_timestamp_ntz``); NaN becomes NULL
    at ingest (Spark orders NaN above every number, pandas treats it as
    missing); sensor columns are unpivoted with an explicit list, so no pass
    over the data discovers the schema. Returns (readings, status) where
    status is ``(ts, status)`` or None.
    """
    from pyspark.sql import functions as F
    ts = (F.to_timestamp_ntz(F.col(ts_col), F.lit(ts_format)) if ts_format
          else F.col(ts_col).cast("timestamp_ntz"))
    base = df.withColumn("ts", ts).drop(ts_col, *[c for c in drop if c in df.columns])
    sensors = [c for c in base.columns if c not in ("ts", status_col)]
    long = base.unpivot(["ts"], sensors, "sensor", "value")
    long = long.withColumn("value", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")))
    status = base.select("ts", F.col(status_col).alias("status")) if status_col in base.columns else None
    return long.select("sensor", "ts", "value"), status
