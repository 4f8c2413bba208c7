"""Projections, filters, recodes and rule classifiers.

Row rules are single ``CASE WHEN`` expressions (codegen), never Python rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_equal_null_safe(col: str, value) -> Column:
    """pandas ``s != v`` keeps missing values; SQL ``<>`` does not."""
    return ~F.col(col).eqNullSafe(F.lit(value))


def status_filter(df: DataFrame, col: str, exclude=(), keep=None) -> DataFrame:
    """Keep rows whose ``col`` is none of ``exclude`` (NULL kept, as pandas),
    optionally restricted to ``keep``."""
    x = df
    for v in exclude:
        x = x.where(not_equal_null_safe(col, v))
    if keep is not None:
        x = x.where(F.col(col).isin(list(keep)))
    return x


def recode(col: str, mapping: dict, default=None) -> Column:
    """``replace({...})`` as a CASE chain; unmapped values -> ``default``
    (None keeps the original value)."""
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    other = F.col(col) if default is None else F.lit(default)
    return other if expr is None else expr.otherwise(other)


def pos_slice(df: DataFrame, lo, hi, pos: str = "pos") -> DataFrame:
    """``iloc[lo:hi]`` (half-open) as a predicate on ``pos``."""
    lo = F.col(lo) if isinstance(lo, str) else F.lit(lo)
    hi = F.col(hi) if isinstance(hi, str) else F.lit(hi)
    return df.where((F.col(pos) >= lo) & (F.col(pos) < hi))


# Line-fault class names and their (G, C, B, A) patterns,
# checked in this order, first match wins; anything else is "No failure".
LINE_FAULTS = [
    ((1, 0, 0, 1), "Fault between phase A and ground"),
    ((0, 1, 1, 0), "Fault between phase B and phase C"),
    ((1, 0, 1, 1), "Fault between phases A,B and ground"),
    ((0, 1, 1, 1), "Fault between all three phases"),
    ((1, 1, 1, 1), "Three phase symmetrical fault"),
]
NO_LINE_FAULT = "No failure"


def line_fault_type(g="g", c="c", b="b", a="a") -> Column:
    expr = None
    for (vg, vc, vb, va), name in LINE_FAULTS:
        cond = (F.col(g) == vg) & (F.col(c) == vc) & (F.col(b) == vb) & (F.col(a) == va)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(NO_LINE_FAULT))


def fault_rules(df: DataFrame, measures=("ia", "ib", "ic", "va", "vb", "vc")) -> DataFrame:
    """``pre_process_EF``: dummies -> fault name and binary target, dummies
    dropped, columns reordered (measures, target, failure_type)."""
    x = df.withColumn("failure_type", line_fault_type())
    x = x.withColumn("target", F.when(F.col("failure_type") == NO_LINE_FAULT, 0).otherwise(1))
    keep = [c for c in df.columns if c not in ("g", "c", "b", "a") and c not in measures]
    return x.select(*keep, *measures, "target", "failure_type")
