"""Plan-shape checks: the physical plans keep the properties the scale
design relies on (bucketed windows, pushed filters, pruned scans)."""

from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ffill_window_is_bucketed(spark):
    p = _plan(E.queries()["ffill_limit"](spark, SF_SMALL))
    win = [l for l in p.split("\n") if "Window [" in l]
    assert win and all("_bkt" in l for l in win)


def test_decompose_window_is_bucketed(spark):
    p = _plan(E.queries()["decompose"](spark, SF_SMALL))
    win = [l for l in p.split("\n") if "Window [" in l and "specifiedwindowframe(RowFrame, -24" in l]
    assert win and all("_bkt" in l for l in win)


def test_range_scan_pushes_time_bounds(spark):
    p = _plan(E.queries()["points_range"](spark, SF_SMALL))
    scan = [l for l in p.split("\n") if "FileScan parquet" in l][0]
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan


def test_feature_scan_reads_only_needed_columns(spark):
    p = _plan(E.queries()["derive_features"](spark, SF_SMALL))
    scans = [l for l in p.split("\n") if "FileScan parquet" in l and "lineitem" in l]
    assert scans and all("l_shipdate" not in l and "l_suppkey" not in l for l in scans)


def test_named_results(spark):
    from vigil.sources.points import points_query, to_points
    from vigil.sources.tables import load
    pts = to_points(load(spark, SF_SMALL, "events"), "events", "ts", "event_type", "value")
    res = points_query(pts, "2024-01-01", "2024-01-02", "events", ["error", "view"])
    assert set(res) == {"fill", "stddev"}
    assert res["stddev"].count() > 0 and res["fill"].count() > 0


def test_points_sink_roundtrip(spark, tmp_path):
    from vigil.sources.points import read_points, to_points, write_points
    from vigil.sources.tables import load
    pts = to_points(load(spark, SF_SMALL, "events"), "events", "ts", "event_type", "value")
    write_points(pts, str(tmp_path / "pts"))
    back = read_points(spark, str(tmp_path / "pts"))
    assert back.count() == pts.count()
    assert sorted(back.columns) == sorted(pts.columns)
