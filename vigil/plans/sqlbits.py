"""SQL text shared by several oracle queries (DuckDB dialect).

These are fixed SQL fragments for the independent oracle; they mirror the
mapping in ``domain.py`` and the grid semantics in ``operators/grid.py``.
"""

from __future__ import annotations

READINGS = "SELECT event_type AS sensor, ts, value FROM events"


def binned_grid(step_s: int, agg: str = "median(value)", src: str = READINGS, name: str = "v",
                keep_epoch: bool = False) -> str:
    """CTE body: per sensor the regular grid of ``step_s`` bins between its
    first and last bin with the aggregate (NULL for empty bins).
    Columns: sensor, ts, pos, <name>."""
    us = step_s * 1_000_000
    return f"""
    WITH r AS ({src}),
    bins AS (SELECT sensor, epoch_us(ts) // {us} AS b, {agg} AS {name} FROM r GROUP BY sensor, epoch_us(ts) // {us}),
    bounds AS (SELECT sensor, min(b) AS b0, max(b) AS b1 FROM bins GROUP BY sensor),
    g AS (SELECT sensor, b0, unnest(range(b0, b1 + 1)) AS b FROM bounds)
    SELECT g.sensor, make_timestamp(g.b * {us}) AS ts, g.b - g.b0 AS pos, bins.{name}
    FROM g LEFT JOIN bins ON g.sensor = bins.sensor AND g.b = bins.b"""
