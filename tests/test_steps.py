"""Steps below a second, and steps that timestamps cannot hold."""

import datetime as dt

import pytest

from vigil.functions.time import step_us
from vigil.operators import evaluate, grid

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_steps_are_exact():
    assert [step_us(s) for s in ("0.5s", "250 ms", "7us", 0.1, 2, "1h", "1.5 minutes", "m", "2 weeks")] == [
        500_000, 250_000, 7, 100_000, 2_000_000, 3_600_000_000, 90_000_000, 60_000_000, 1_209_600_000_000]
    for bad in ("0.5us", 0, "0s", 1e-7, "0.0000001 s"):
        with pytest.raises(ValueError):
            step_us(bad)


def test_half_second_grid(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(500), 2.0), ("a", at(700), 9.0), ("a", at(1500), 4.0)],
                               "sensor string, ts timestamp_ntz, value double")
    rows = sorted((r.pos, r.ts, r.value) for r in grid.regularize(df, "0.5s").collect())
    assert [(p, t) for p, t, _ in rows] == [(i, at(500 * i)) for i in range(4)] and [v for _, _, v in rows] == [1.0, 2.0, None, 4.0]
    got = {r.ts: r.value for r in grid.resample(df, "500ms", "mean").collect()}
    assert got == {at(0): 1.0, at(500): 5.5, at(1000): None, at(1500): 4.0}
    assert {r.ts: r["count"] for r in grid.window_stats(df, "0.25s", ("count",)).collect()}[at(750)] == 2


def test_episodes_with_a_gap_below_a_second(spark):
    df = spark.createDataFrame([("a", at(m)) for m in (0, 100, 190, 500)], "sensor string, ts timestamp_ntz")
    got = sorted((r.start, r.end, r.n_alarms) for r in evaluate.alarm_episodes(df, "sensor", "0.2s").collect())
    assert got == [(at(0), at(390), 3), (at(500), at(700), 1)]
