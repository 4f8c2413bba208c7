"""Structured Streaming twins of the batch operators.

Streams run on event time: naive timestamps are cast to TIMESTAMP (UTC
session) because watermarks need it. Sinks are idempotent Parquet folders
under the shared checkpoint location (``spark.checkpoint.dir``); the query
checkpoint sits next to them, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import checkpoint_dir, ensure_session


def run_dir(spark: SparkSession, name: str) -> str:
    """Fresh sink + checkpoint folder for one run, inside the shared folder."""
    d = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:10]}")
    return d


def read_events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """File stream over the events table (a new file = a new micro-batch)."""
    ensure_session(spark)
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                 .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def as_readings(stream: DataFrame) -> DataFrame:
    return stream.select(F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_parquet(df: DataFrame, path: str, mode: str = "append", partition_by=None) -> None:
    """Drain the available input (``availableNow``) into a Parquet sink. State
    is kept on disk (RocksDB)."""
    spark, name = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    w = (df.writeStream.format("parquet").outputMode(mode)
           .option("path", os.path.join(path, "out")).option("checkpointLocation", os.path.join(path, "chk"))
           .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "out"))


# ---------------------------------------------------------------- S1
def ingest(stream: DataFrame, path: str, watermark: str = "1 hour") -> None:
    """Points ingest: tag, dedupe on (field, ts) within the watermark, write
    each micro-batch idempotently (a batch id rewrites only its own folder)."""
    pts = (stream.select(F.lit("events").alias("measurement"), F.lit("Original").alias("stamp"),
                         F.col("event_type").alias("field"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("value").cast("double").alias("value"))
                 .where(F.col("value").isNotNull())
                 .withWatermark("ts", watermark)
                 .dropDuplicatesWithinWatermark(["field", "ts"]))

    def write_batch(batch: DataFrame, batch_id: int):
        (batch.withColumn("day", F.to_date("ts"))
              .write.mode("overwrite").partitionBy("day")
              .parquet(os.path.join(path, "out", f"batch={batch_id}")))
    (pts.writeStream.foreachBatch(write_batch).option("checkpointLocation", os.path.join(path, "chk"))
        .trigger(availableNow=True).start().awaitTermination())


# ---------------------------------------------------------------- S2
def window_stats(readings: DataFrame, every: str = "20 minutes", slide: str | None = None,
                 watermark: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) window stddev/mean/count per sensor, append mode:
    a window is emitted once the watermark passes its end."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (readings.withWatermark("ts", watermark).groupBy(w.alias("w"), "sensor")
                    .agg(F.stddev_samp("value").alias("stddev"), F.avg("value").alias("mean"),
                         F.count(F.lit(1)).alias("n"))
                    .select("sensor", F.col("w.start").alias("start"), F.col("w.end").alias("stop"),
                            "stddev", "mean", "n"))


# ---------------------------------------------------------------- S3
def zscore_alarms(readings: DataFrame, baseline: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Stream-static join with a (sensor, hour slot) baseline table; no state."""
    x = readings.withColumn("slot", F.hour("ts"))
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return (x.join(baseline, ["sensor", "slot"], "left")
             .withColumn("z_raw", F.round(z, 6))
             .withColumn("z", F.when(F.abs("z_raw") >= threshold, F.col("z_raw")).otherwise(F.lit(0.0)))
             .select("sensor", "ts", "value", "z"))


# ---------------------------------------------------------------- S4
def episodes(alarms: DataFrame, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    return (alarms.withWatermark("ts", watermark)
                  .groupBy("sensor", F.session_window("ts", gap).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n_alarms"))
                  .select("sensor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_alarms"))


# ---------------------------------------------------------------- S5
FFILL_OUT = "sensor string, ts timestamp, value double, filled boolean"
MINUTE_MS = 60_000


class FillProcessor(StatefulProcessor):
    """Carries each sensor's last value over missing minutes.

    Its rows are closed minutes (one row each); the state is the last real
    minute, its value and the last minute emitted. What lies between two real
    minutes is filled when the second one arrives; what follows the last one
    is filled as the watermark closes each minute, for which a timer is set."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "minute long, value double, emitted long")

    def handleInputRows(self, key, rows, timerValues):
        minutes, values = [], []
        for pdf in rows:
            minutes.append(pdf["minute"].to_numpy(dtype=np.int64))
            values.append(pdf["value"].to_numpy(dtype=float))
        minutes, values = np.concatenate(minutes), np.concatenate(values)
        order = np.argsort(minutes, kind="stable")
        yield self._emit(key, minutes[order], values[order], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._emit(key, np.zeros(0, np.int64), np.zeros(0), timerValues)

    def _emit(self, key, minutes, values, timers) -> pd.DataFrame:
        state = self.last.get() if self.last.exists() else None
        if state is not None:  # the last real minute goes on as a row that is already out
            minutes, values = np.concatenate([[state[0]], minutes]), np.concatenate([[state[1]], values])
        if not len(minutes):
            return self._rows(key, minutes, values, np.zeros(0, bool))
        done = state[2] if state is not None else minutes[0] - 1
        closed = timers.getCurrentWatermarkInMs() // MINUTE_MS - 1  # the last minute that has ended
        until = np.append(minutes[1:], max(closed, minutes[-1]) + 1)
        n = np.minimum(until - minutes, self.limit + 1)  # the minute itself and what it fills
        source = np.repeat(np.arange(len(minutes)), n)
        k = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
        at = minutes[source] + k
        new = at > done
        last = int(max(at.max(), done))
        self.last.update((int(minutes[-1]), float(values[-1]), last))
        if last < minutes[-1] + self.limit:
            self.handle.registerTimer(int(last + 2) * MINUTE_MS)
        return self._rows(key, at[new], values[source[new]], k[new] > 0)

    @staticmethod
    def _rows(key, at, values, filled) -> pd.DataFrame:
        return pd.DataFrame({"sensor": key[0], "ts": pd.to_datetime(at * MINUTE_MS, unit="ms"), "value": values, "filled": filled})

    def close(self) -> None:
        pass


def ffill_stream(readings: DataFrame, limit_min: int = 60, watermark: str = "1 hour") -> DataFrame:
    """Last-value fill with a limit across micro-batches (append mode).

    A minute's value is its latest reading (of several at the same time the
    largest). Minutes are combined per (sensor, minute) first, however they are
    split over files, and go on when the watermark has passed their end; so a
    sensor's readings never meet in one task, only its minutes do. Missing
    minutes get the last value, at most ``limit_min`` of them, also after a
    sensor's last reading, as soon as the watermark has closed them. Readings
    behind the watermark are dropped; null values do not count."""
    minutes = (readings.where(F.col("value").isNotNull()).withWatermark("ts", watermark)
               .groupBy("sensor", F.window("ts", "1 minute").alias("w"))
               .agg(F.max(F.struct("ts", "value"))["value"].alias("value"))
               .select("sensor", (F.unix_millis("w.start") / MINUTE_MS).cast("long").alias("minute"), "value", F.window_time("w").alias("at")))
    return minutes.groupBy("sensor").transformWithStateInPandas(FillProcessor(limit_min), FFILL_OUT, "append", "eventTime")
