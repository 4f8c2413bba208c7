"""Inverse standard-normal CDF as a column expression (no Python UDF).

Peter Acklam's rational approximation (public domain, relative error below
1.15e-9): a central rational function in (p - 0.5) and two tail functions in
sqrt(-2 log p).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of the approximation.
A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549671010322563e+00, 4.374664141464968e+00, 2.938163982698783e+00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00]
P_LOW = 0.02425


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_norm(p: Column) -> Column:
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    lo = _horner(C, q_lo) / (_horner(D, q_lo) * q_lo + F.lit(1.0))
    hi = -_horner(C, q_hi) / (_horner(D, q_hi) * q_hi + F.lit(1.0))
    mid = _horner(A, r) * q / (_horner(B, r) * r + F.lit(1.0))
    return F.when(p < P_LOW, lo).when(p > 1 - P_LOW, hi).otherwise(mid)


def inv_norm_sql(p: str) -> str:
    """The same formula as DuckDB SQL text (for the oracle)."""
    def horner(coefs, x):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc}) * {x} + {c!r}"
        return acc
    qlo, qhi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    lo = f"({horner(C, qlo)}) / (({horner(D, qlo)}) * {qlo} + 1.0)"
    hi = f"-({horner(C, qhi)}) / (({horner(D, qhi)}) * {qhi} + 1.0)"
    mid = f"({horner(A, r)}) * {q} / (({horner(B, r)}) * {r} + 1.0)"
    return f"CASE WHEN {p} < {P_LOW} THEN {lo} WHEN {p} > {1 - P_LOW!r} THEN {hi} ELSE {mid} END"
