"""Result sinks and re-reads.

Result tables are written long (``model, sensor, ts, z``), partitioned by
model, to a folder in the shared checkpoint location; the re-read uses an
explicit schema (no inference pass) and rebuilds the timestamp from its text
form, dropping the string copy.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def result_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "results", f"{name}-{uuid.uuid4().hex[:10]}")


def write_scores_csv(df: DataFrame, path: str, ts: str = "ts") -> None:
    """CSV with header, one folder per model; the timestamp goes out as text."""
    (df.withColumn("timestamp", F.date_format(ts, TS_FORMAT)).drop(ts)
       .write.mode("overwrite").option("header", True).partitionBy("model").csv(path))


SCORES_CSV_SCHEMA = T.StructType([
    T.StructField("sensor", T.StringType()), T.StructField("z", T.DoubleType()),
    T.StructField("timestamp", T.StringType()), T.StructField("model", T.StringType())])


def read_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    """Re-read with the explicit schema, rebuild the time index, drop the text."""
    df = spark.read.schema(SCORES_CSV_SCHEMA).option("header", True).csv(path)
    return (df.withColumn("ts", F.to_timestamp_ntz("timestamp", F.lit(TS_FORMAT))).drop("timestamp")
              .select("model", "sensor", "ts", "z"))
