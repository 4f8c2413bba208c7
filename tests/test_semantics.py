"""Layers 2-3: hand-made fixtures for edge semantics and properties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import bucketing, cluster, evaluate, features, grid, shape, stats, warping
from vigil.operators.decompose import decompose

T0 = dt.datetime(2024, 1, 1)


def _series(spark, values, sensor="s", step_min=1):
    rows = [(sensor, T0 + dt.timedelta(minutes=i * step_min), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, pos long, value double")


@pytest.mark.parametrize("gap", [59, 60, 61])
def test_ffill_limit_gap(spark, gap):
    vals = [1.0] + [None] * gap + [2.0]
    out = grid.ffill_limit(_series(spark, vals), 60, bucket=16).orderBy("pos").collect()
    filled = [r.value for r in out]
    expect = [1.0] + [1.0 if i < 60 else None for i in range(gap)] + [2.0]
    assert filled == expect


def test_fill_never_changes_present_values(spark):
    rng = np.random.default_rng(1)
    vals = [float(v) if rng.random() > 0.4 else None for v in rng.normal(size=500)]
    df = _series(spark, vals)
    for out in (grid.ffill_limit(df, 7, bucket=32), grid.fill_previous(df, bucket=32)):
        got = {r.pos: r.value for r in out.collect()}
        for i, v in enumerate(vals):
            if v is not None:
                assert got[i] == v


@pytest.mark.parametrize("bucket", [8, 61, 4096])
def test_bucketed_windows_exact(spark, bucket):
    """Halo buckets and two-level scans give the same answer as one window."""
    rng = np.random.default_rng(7)
    vals = [float(v) if rng.random() > 0.5 else None for v in rng.normal(size=400)]
    df = _series(spark, vals)
    a = {r.pos: r.value for r in grid.ffill_limit(df, 5, bucket=bucket).collect()}
    b = {r.pos: r.value for r in grid.fill_previous(df, bucket=bucket).collect()}
    last, lastpos = None, None
    for i, v in enumerate(vals):
        if v is not None:
            last, lastpos = v, i
        assert b[i] == last
        assert a[i] == (last if lastpos is not None and i - lastpos <= 5 else None)


@pytest.mark.parametrize("levels,exclusive", [(2, False), (3, False), (3, True), (4, True)])
def test_carry_forward_levels(spark, levels, exclusive):
    """Every summary depth gives the plain running last-non-null, including
    long NULL runs that cross several super-buckets."""
    rng = np.random.default_rng(11)
    vals = [float(v) if rng.random() > 0.93 else None for v in rng.normal(size=600)]
    df = _series(spark, vals).unionByName(_series(spark, vals[::-1], sensor="t"))
    out = bucketing.carry_forward(df, ["sensor"], "pos", "value", "cf", bucket=4,
                                  levels=levels, exclusive=exclusive).collect()
    got = {(r.sensor, r.pos): r.cf for r in out}
    for name, series in (("s", vals), ("t", vals[::-1])):
        last = None
        for i, v in enumerate(series):
            if not exclusive and v is not None:
                last = v
            assert got[(name, i)] == last
            if exclusive and v is not None:
                last = v


def test_regularize_drops_off_grid_rows(spark):
    rows = [("s", T0, 1.0), ("s", T0 + dt.timedelta(seconds=90), 5.0), ("s", T0 + dt.timedelta(minutes=3), 3.0)]
    df = spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, value double")
    out = grid.regularize(df, "1 minute", values=["value"]).orderBy("pos").collect()
    assert [r.value for r in out] == [1.0, None, None, 3.0]


def test_between_time_minute_labels(spark):
    rows = [(1, T0 + dt.timedelta(hours=11, minutes=59)), (2, T0 + dt.timedelta(hours=11, minutes=59, seconds=30)),
            (3, T0), (4, T0 + dt.timedelta(hours=12))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    got = sorted(r.id for r in shape.between_time(df, "00:00", "11:59").collect())
    assert got == [1, 3]


def test_iqr_fence_inclusive(spark):
    # q1 = 1, q3 = 2 -> fences -2 and 5; both boundary values are flagged
    vals = [1.0, 1.0, 2.0, 2.0, -2.0, 5.0, 4.9]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "sensor string, i int, value double")
    fit = df.where(F.col("i") < 4)
    b = stats.iqr_bounds(fit, "sensor", "value").first()
    assert (b.q1, b.q3, b.lower, b.upper) == (1.0, 2.0, -2.0, 5.0)
    out = stats.iqr_fence(df, "sensor", "value", fit=fit)
    flags = {r.i: r.flag for r in out.collect()}
    assert flags[4] == 1 and flags[5] == 1 and flags[6] == 0


def test_zero_denominator_metrics(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 0, 0)], "k string, label int, alarm int")
    r = stats.binary_metrics(df, "k", "label", "alarm").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def _scored(spark, rows):
    return spark.createDataFrame([("s", T0 + dt.timedelta(seconds=s), l, a) for s, l, a in rows],
                                 "sensor string, ts timestamp_ntz, label int, alarm int")


def test_point_adjusted_detection_on_last_point(spark):
    # segment of 3 points, alarm only on its last point; one false alarm
    df = _scored(spark, [(0, 0, 0), (60, 1, 0), (120, 1, 0), (180, 1, 1), (240, 0, 1)])
    r = evaluate.point_adjusted(df, "sensor").first()
    assert (r.tp, r.fp, r.fn) == (3, 1, 0)
    assert r.mttd_s == 120.0
    raw = stats.binary_metrics(df, "sensor", "label", "alarm").first()
    assert r.recall >= raw.recall  # PA recall >= raw recall


def test_revised_pa_early_window(spark):
    # segments start at 1000 and 5000; alarms 600 s and 601 s before them
    df = _scored(spark, [(400, 0, 1), (1000, 1, 0), (1060, 1, 0), (4399, 0, 1), (5000, 1, 0), (8000, 0, 0)])
    r = evaluate.revised_point_adjusted(df, "sensor", early_s=600).first()
    assert (r.tp, r.fn, r.fp) == (1, 1, 1)
    assert r.mttd_s is None  # detected only by the early alarm


def test_segments_across_day_buckets(spark):
    rows = [(86400 - 60, 1, 0), (86400 + 60, 1, 0), (2 * 86400, 0, 0), (2 * 86400 + 5, 1, 0)]
    segs = evaluate.segments(_scored(spark, rows), "sensor").collect()
    assert sorted(r.n_points for r in segs) == [1, 2]


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(3)
    x = (np.sin(np.arange(200) * 2 * np.pi / 12) * 5 + rng.normal(size=200)).tolist()
    out = decompose(_series(spark, x), 12, bucket=16).collect()
    for r in out:
        if r.trend is not None:
            assert abs(r.trend + r.seasonal + r.resid - r.value) < 1e-9
    # trend is NULL exactly for the first p rows (even period)
    assert sum(r.trend is None for r in out) == 12


def test_folds_disjoint_and_covering(spark):
    folds = shape.folds_table(spark, 100, 10, 40, 4, "expanding").collect()
    tests = sorted((r.lo, r.hi) for r in folds if r.role == "test")
    assert tests == [(100, 110), (110, 120), (120, 130), (130, 140)]
    sl = shape.folds_table(spark, 100, 10, 40, 4, "sliding").collect()
    tr0 = [r for r in sl if r.role == "train" and r.fold == 0][0]
    assert (tr0.lo, tr0.hi) == (60, 99)  # the reference drops the last train row


def test_series_folds_follow_each_length(spark):
    """Two lengths: tests are disjoint and reach the end of their own series."""
    df = spark.createDataFrame([("a", p) for p in range(75)] + [("b", p) for p in range(151)], "sensor string, pos long")
    for mode, first in (("expanding", 0), ("baseline", 0), ("sliding", 1)):
        folds = shape.series_folds(df, mode=mode)
        for s, n in (("a", 75), ("b", 151)):
            tests = sorted((r.lo + first, r.hi) for r in folds.where((F.col("sensor") == s) & (F.col("role") == "test")).collect())
            assert tests[0][0] == n * 8 // 15 and tests[-1][1] == n
            assert all(x[1] == y[0] for x, y in zip(tests, tests[1:]))
        rows = shape.walk_forward(df, folds)
        assert rows.where("role = 'test' AND fold = 3").agg(F.max("pos")).first()[0] == 150
        assert rows.where("role = 'train' AND sensor = 'a'").agg(F.max("pos")).first()[0] < 75


def test_scaler_train_in_unit_interval(spark):
    rows = [(i, float(i % 7), 3.0, "train" if i % 3 else "test") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, c double, split string")
    out = features.minmax_scale(df, ["a", "c"]).where("split = 'train'").collect()
    assert all(0.0 <= r.a <= 1.0 for r in out)
    assert all(r.c == 0.0 for r in out)  # constant column scales to 0


def test_dtw_properties():
    a, b = np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 2, 3])
    assert warping.dtw_distance(a, a) == 0.0
    assert warping.dtw_distance(a, b) == warping.dtw_distance(b, a)
    c = np.array([1.0, 2, 3, 4])
    assert warping.dtw_distance(a, c) <= float(((a - c) ** 2).sum())


def test_invariant_under_repartition(spark):
    from vigil.plans.domain import scored_events
    e = scored_events(spark, "/root/testdata/sf0.001")
    a = sorted(map(tuple, evaluate.point_adjusted(e, "sensor").collect()))
    b = sorted(map(tuple, evaluate.point_adjusted(e.repartition(7, "ts"), "sensor").collect()))
    assert a == b


def test_cumsum_two_level(spark):
    rows = [("k", i, i // 10, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o int, b int, v int")
    out = bucketing.bucketed_cumsum(df, ["k"], "o", "v", "cs", "b").collect()
    assert all(r.cs == r.o + 1 for r in out)


@pytest.mark.parametrize("rows", [2, 5, 1_000_000])
def test_segments_exact_for_any_bucket_size(spark, rows):
    from vigil.plans.domain import scored_events
    e = scored_events(spark, "/root/testdata/sf0.001")
    ref = sorted((r.sensor, r.ts, r.seg_no) for r in evaluate.with_segments(e, "sensor").where("label = 1").collect())
    got = sorted((r.sensor, r.ts, r.seg_no)
                 for r in evaluate.with_segments(e, "sensor", bucket_rows=rows).where("label = 1").collect())
    assert got == ref


def test_quantiles_do_not_depend_on_ranges(spark):
    import numpy as np
    from vigil.functions.quantiles import group_quantiles
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=301).round(1), "b": rng.integers(0, 3, 50).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "sensor string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for ranges in (1, 2, 7, 64):
        got = {r.sensor: r["_q"] for r in group_quantiles(df, "sensor", "value", probs, ranges=ranges).collect()}
        assert set(got) == set(data)
        for k, vs in data.items():
            assert np.allclose(got[k], np.quantile(vs, probs))


def test_wide_csv_ingest(spark, tmp_path):
    from vigil.sources.tables import pump_wide_schema, read_csv, wide_to_readings
    lines = ["row_id,timestamp,sensor_00,sensor_01,machine_status",
             "0,2018-04-01 00:00:00,1.5,NaN,NORMAL",
             "1,2018-04-01 00:01:00,,2.0,",
             "2,2018-04-01 00:02:00,3.0,4.0,BROKEN"]
    p = tmp_path / "pump.csv"
    p.write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(p), pump_wide_schema(2))
    r, status = wide_to_readings(df)
    got = sorted((x.sensor, x.ts.minute, x.value) for x in r.collect())
    assert got == [("sensor_00", 0, 1.5), ("sensor_00", 1, None), ("sensor_00", 2, 3.0),
                   ("sensor_01", 0, None), ("sensor_01", 1, 2.0), ("sensor_01", 2, 4.0)]
    assert status.where("status IS NULL").count() == 1


def test_decomposition_odd_period(spark):
    x = [float(i % 7) + 0.1 * i for i in range(100)]
    out = decompose(_series(spark, x), 7, bucket=8).orderBy("pos").collect()
    assert sum(r.trend is None for r in out) == 6
    r = out[10]
    assert abs(r.trend - sum(x[4:11]) / 7) < 1e-12


def test_stream_episodes_match_batch(spark):
    import __spark_entry__ as E
    s = {(r.sensor, r.start.replace(tzinfo=None), r.n_alarms) for r in
         E.queries()["stream_episodes"](spark, "/root/testdata/sf0.001").collect()}
    b = {(r.sensor, r.start, r.n_alarms) for r in
         E.queries()["alarm_episodes"](spark, "/root/testdata/sf0.001").collect()}
    assert s and s <= b   # closed episodes only (the watermark holds the last ones)


def test_isolation_tree_lookup_lands_in_containing_leaf():
    """Leaves partition the line; cuts on sample values create empty [a, a)
    leaves, and a lookup of a must still land in the leaf containing a."""
    from vigil.operators.detect import _tree_leaves
    rng = np.random.default_rng(5)
    for trial in range(300):
        base = rng.normal(size=int(rng.integers(2, 400)))
        # heavy ties and near-ties (1 ulp apart) make cuts hit sample values
        vals = np.concatenate([np.round(base, 1), np.nextafter(np.round(base[:20], 1), np.inf)])
        lows, highs, paths = _tree_leaves(vals, int(rng.integers(0, 2**62)))
        assert np.all(np.diff(lows) >= 0) and np.isneginf(lows[0])
        probe = np.concatenate([vals, lows[1:]])
        idx = np.clip(np.searchsorted(lows, probe, side="right") - 1, 0, len(lows) - 1)
        assert np.all((lows[idx] <= probe) & (probe < highs[idx]))


def test_bin_median_is_exact_in_dense_bins(spark):
    """One path for every density: a bin of many values and ties, small bins,
    a bin of nulls and an empty bin."""
    rng = np.random.default_rng(3)
    rows = [("s", T0 + dt.timedelta(seconds=int(x)), float(v))
            for x, v in zip(rng.integers(0, 600, 5000), np.round(rng.normal(size=5000), 2), strict=True)]
    rows += [("s", T0 + dt.timedelta(minutes=m), float(v)) for m, v in ((11, 4), (12, 7), (31, 5))]
    rows += [("s", T0 + dt.timedelta(minutes=41), None)]
    df = spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, value double")
    got = {r.ts: r.value for r in grid.resample(df, "10 minutes", "median").collect()}
    both = {r.ts: (r.median, r["count"]) for r in grid.window_stats(df, "10 minutes", ("median", "count"), label="start").collect()}
    assert len(got) == 5 and both.keys() == got.keys()
    for b in got:
        vals = [v for (_, t, v) in rows if b <= t < b + dt.timedelta(minutes=10) and v is not None]
        want = float(np.median(vals)) if vals else None
        assert both[b] == (pytest.approx(want, abs=1e-12), len(vals)) if vals else both[b] == (None, 0)
        assert got[b] == (pytest.approx(want, abs=1e-12) if vals else None)


def test_alarm_episodes_equal_session_windows(spark):
    """Gaps just under, at and over the limit, tied alarms, and bucket edges."""
    from vigil.operators.evaluate import alarm_episodes
    rng = np.random.default_rng(11)
    rows = []
    for s in ("a", "b", "c"):
        t = 0
        for _ in range(300):
            t += int(rng.choice([0, 1, 599, 600, 601, 1800, 9000]))
            rows.append((s, T0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "sensor string, ts timestamp_ntz")
    want = set()
    for s in ("a", "b", "c"):
        open_ = None
        for t in sorted(t for k, t in rows if k == s):
            if open_ is None or t - open_[1] >= dt.timedelta(minutes=10):
                if open_:
                    want.add((s, open_[0], open_[1] + dt.timedelta(minutes=10), open_[2]))
                open_ = [t, t, 0]
            open_[1], open_[2] = t, open_[2] + 1
        want.add((s, open_[0], open_[1] + dt.timedelta(minutes=10), open_[2]))
    for bucket_s in (600, 3600, 86400):
        got = [tuple(r) for r in alarm_episodes(df, "sensor", "10 minutes", bucket_s=bucket_s).collect()]
        assert len(got) == len(want) and set(got) == want


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace
    from vigil.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_softdtw_gamma_is_the_median_distance_of_points(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 24))
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "sensor string, chunk_id long, vals array<double>")
    v = x.ravel()
    want = 2 * np.median(np.abs(v[:, None] - v[None, :])) ** 2 * 24
    got = cluster.softdtw_gamma(df, "sensor").first()["gamma"]
    assert abs(got / want - 1) < 0.1
