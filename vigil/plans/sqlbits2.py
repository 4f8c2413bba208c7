"""More shared oracle SQL (DuckDB): machine table with failure rules,
derived features, line-fault dummies, point labels."""

from __future__ import annotations

from .domain import MACHINE_SQL
from .sqlbits import binned_grid

MACHINE_LABELED_SQL = f"""
  WITH m AS ({MACHINE_SQL}),
  r AS (SELECT *, abs(air_k - process_k) AS _heat, torque * rpm * CAST(0.10472 AS DOUBLE) AS _power, wear * torque AS _strain,
               CASE type WHEN 'A' THEN 11000 WHEN 'N' THEN 12000 WHEN 'R' THEN 13000 END AS _limit FROM m)
  SELECT l_orderkey, l_linenumber, type, air_k, process_k, rpm, torque, wear,
         CASE WHEN _heat < 8.6 AND rpm < 1380 THEN 'Heat Dissipation Failure'
              WHEN _power < 3500 OR _power > 9000 THEN 'Power Failure'
              WHEN _strain > _limit THEN 'Overstrain Failure'
              WHEN wear BETWEEN 200 AND 240 AND torque > 40 THEN 'Tool Wear Failure'
              WHEN random_fault THEN 'Random Failures'
              ELSE 'No Failure' END AS failure_type
  FROM r"""

MACHINE_TARGET_SQL = f"""
  SELECT *, CASE WHEN failure_type = 'No Failure' THEN 0 ELSE 1 END AS target FROM ({MACHINE_LABELED_SQL})"""

RELABELED_SQL = f"""
  SELECT l_orderkey, l_linenumber, type, air_k, process_k, rpm, torque, wear,
         CASE WHEN failure_type = 'Random Failures' THEN 0 ELSE target END AS target,
         CASE WHEN failure_type = 'Random Failures' THEN 'No Failure' ELSE failure_type END AS failure_type
  FROM ({MACHINE_TARGET_SQL})"""

FEATURES_SQL = f"""
  WITH x AS ({RELABELED_SQL}),
  tc AS (SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT type FROM x)),
  fc AS (SELECT failure_type, CAST(dense_rank() OVER (ORDER BY failure_type) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT failure_type FROM x))
  SELECT l_orderkey, l_linenumber, tc.code AS type, torque * (rpm * CAST(0.10472 AS DOUBLE)) AS power, process_k,
         abs(air_k - process_k) AS heat, wear, wear * torque AS overstrain, rpm, target, fc.code AS failure_type
  FROM x JOIN tc ON x.type = tc.type JOIN fc ON x.failure_type = fc.failure_type"""

HASH_UNIT_SQL = ("(((l_orderkey % 1000003) * 2654435761 + (l_linenumber % 1000003) * 40503) % 4294967296)"
                 " / 4294967296.0")

LINE_FAULT_SQL = """
  SELECT l_orderkey, l_linenumber,
         CAST(l_linestatus = 'F' AS INTEGER) AS g, (l_linenumber >> 2) & 1 AS c,
         (l_linenumber >> 1) & 1 AS b, l_linenumber & 1 AS a,
         l_quantity AS ia, l_extendedprice / 1000 AS ib, l_discount * 100 AS ic,
         l_tax * 100 AS va, l_quantity * l_discount AS vb, l_extendedprice * l_tax / 100 AS vc
  FROM lineitem"""

# error-event count per hourly bin; label 1 when above the 0.9 quantile of counts
POINT_LABELS_SQL = f"""
  WITH c AS ({binned_grid(3600, 'count(*)', src="SELECT 'error' AS sensor, ts, value FROM events WHERE event_type = 'error'", name='n')}),
  c2 AS (SELECT ts, coalesce(n, 0) AS n FROM c),
  q AS (SELECT quantile_cont(n, 0.9) AS q90 FROM c2)
  SELECT ts, CAST(n > q90 AS INTEGER) AS label FROM c2, q"""


def series_folds_sql(series: str) -> str:
    """Bounds of four folds from each series' own length: sensor, fold, n, s
    (the first split), start and stop of the test part."""
    return f"""
  SELECT sensor, CAST(i AS INTEGER) AS fold, n, s, s + wf * i AS start, CASE WHEN i = 3 THEN n ELSE s + wf * (i + 1) END AS stop
  FROM (SELECT sensor, n, n * 8 // 15 AS s, (n - n * 8 // 15) // 4 AS wf FROM (SELECT sensor, max(pos) + 1 AS n FROM ({series}) GROUP BY sensor)),
       range(4) t(i)"""
