"""Layer 4 (stream = batch on closed windows) and model sanity floors."""

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL

import __spark_entry__ as E
from vigil.functions.time import epoch_us
from vigil.operators import grid
from vigil.plans.domain import readings


def test_stream_windows_equal_batch(spark):
    s = E.queries()["stream_window_stddev"](spark, SF_SMALL)
    b = grid.window_aggregate(readings(spark, SF_SMALL), "20 minutes", "stddev", label="start",
                              create_empty=False)
    b = b.withColumn("value", F.round("value", 6))
    sj = {(r.sensor, r.start.replace(tzinfo=None)): r.stddev for r in s.collect()}
    bj = {(r.sensor, r.ts): r.value for r in b.collect()}
    assert sj and set(sj) <= set(bj)   # the stream emits only windows closed by the watermark
    for k, v in sj.items():
        assert (v is None and bj[k] is None) or abs(v - bj[k]) < 1e-6


def test_stream_ingest_dedupes(spark):
    df = E.queries()["stream_ingest"](spark, SF_SMALL)
    assert df.count() == df.select("field", "ts").distinct().count()


def test_stream_ffill_limit(spark):
    df = E.queries()["stream_ffill"](spark, SF_SMALL)
    assert df.where("NOT filled").count() > 0
    # no filled run longer than 60 minutes after a real value
    from pyspark.sql import Window
    w = Window.partitionBy("sensor").orderBy("ts")
    x = df.withColumn("real", F.when(~F.col("filled"), F.col("ts")))
    x = x.withColumn("last_real", F.last("real", ignorenulls=True).over(w))
    gap = (epoch_us("ts") - epoch_us("last_real")) / 60_000_000
    assert x.where(F.col("filled") & (gap > 60)).count() == 0


def test_forest_learns_machine_status(spark):
    r = {x.target_name: x for x in E.queries()["fit_forest"](spark, SF_MID).collect()}
    assert r["target"].balanced_accuracy > 90
    assert r["failure_type"].micro_f1 > 90


def test_isolation_forest_scores_in_range(spark):
    df = E.queries()["forest_scores"](spark, SF_MID)
    r = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert 0 < r.lo <= r.hi < 1


def fill_of_files(spark, tmp_path, name, files, limit=60):
    """The filled rows of a stream that reads one file a micro-batch, and the
    number of batches."""
    import os
    import pandas as pd
    from vigil.streaming import stream as S
    src = tmp_path / f"{name}-src"
    src.mkdir()
    for i, rows in enumerate(files):
        f = src / f"part-{i}.parquet"
        pd.DataFrame(rows, columns=["sensor", "ts", "value"]).astype({"ts": "datetime64[us]", "value": float}).to_parquet(f, index=False)
        os.utime(f, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))   # file order = time order
    st = (spark.readStream.schema("sensor string, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
          .select("sensor", F.col("ts").cast("timestamp").alias("ts"), "value"))
    out = str(tmp_path / name)
    S.run_to_parquet(S.ffill_stream(st, limit), out)
    rows = sorted((r.sensor, r.ts.replace(tzinfo=None), r.value, r.filled) for r in S.read_back(spark, out).collect())
    return rows, len([f for f in os.listdir(f"{out}/chk/commits") if f.isdigit()])


def test_stream_ffill_of_split_minutes_equals_one_batch(spark, tmp_path):
    """Events split in time into three files, with minutes split over files."""
    import os
    import pyarrow.parquet as pq
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet")).to_pandas().sort_values("ts")[["event_type", "ts", "value"]]
    t["ts"] = t["ts"].dt.floor("20s")  # ties too
    rows = list(t.itertuples(index=False, name=None))
    third = len(rows) // 3
    files = [rows[:third], rows[third:2 * third], rows[2 * third:]]
    extra = [(s, ts, v + 1000) for s, ts, v in files[0][-5:]]  # the same minutes again in the next file
    one, _ = fill_of_files(spark, tmp_path, "one", [rows + extra])
    three, batches = fill_of_files(spark, tmp_path, "three", [files[0], extra + files[1], files[2]])
    assert batches >= 3 and three == one and any(r[3] for r in one) and any(not r[3] for r in one)
    assert any(r[2] > 1000 for r in one)


def test_stream_ffill_after_the_last_value_and_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1, 12)
    at = lambda m, s=0: t0 + timedelta(minutes=m, seconds=s)
    files = [[("a", at(0, 5), 1.0), ("a", at(0, 50), 2.0), ("b", at(3), 7.0), ("b", at(3), 6.0), ("c", at(1), None)],
             [("a", at(300), 5.0)],                       # the watermark moves to minute 240
             [("a", at(301), 6.0)],                       # which closes minutes 0 and 3
             [("a", at(10), 99.0), ("b", at(420), 8.0)]]  # minute 10 is late by then
    got, _ = fill_of_files(spark, tmp_path, "tail", files, limit=10)
    minutes = lambda s: {int((r[1] - t0).total_seconds() // 60): (r[2], r[3]) for r in got if r[0] == s}
    a, b = minutes("a"), minutes("b")
    # at minute 420 the watermark is at 360: 300 and 301 are closed, 420 is not
    assert a == {0: (2.0, False), **{m: (2.0, True) for m in range(1, 11)}, 300: (5.0, False), 301: (6.0, False), **{m: (6.0, True) for m in range(302, 312)}}
    assert b == {3: (7.0, False), **{m: (7.0, True) for m in range(4, 14)}} and minutes("c") == {}
