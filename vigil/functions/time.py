"""Time column expressions (JVM-side, codegen friendly).

All timestamps are naive wall-clock values (``timestamp_ntz``). Under the UTC
session zone set by ``vigil.session.ensure_session`` the casts below are exact.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SEC = 1_000_000

_UNITS = {
    "us": Fraction(1, 1_000_000), "microsecond": Fraction(1, 1_000_000), "microseconds": Fraction(1, 1_000_000),
    "ms": Fraction(1, 1_000), "millisecond": Fraction(1, 1_000), "milliseconds": Fraction(1, 1_000),
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
}


def step_us(step: str | int | float) -> int:
    """'20 minutes' / '1h' / '0.5s' / '250ms' / 3600 (seconds) -> microseconds,
    exactly. A step that is not a whole, positive number of microseconds (the
    resolution of timestamps) is an error; it is never rounded."""
    if isinstance(step, (int, float)):
        us = Fraction(str(step)) * US_PER_SEC
    else:
        s = step.strip().lower().replace(" ", "")
        num = "".join(ch for ch in s if ch.isdigit() or ch == ".")
        us = Fraction(num or 1) * _UNITS[s[len(num):]] * US_PER_SEC
    if us.denominator != 1 or us < 1:
        raise ValueError(f"step {step!r} is not a whole, positive number of microseconds")
    return int(us)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Naive timestamp -> microseconds since 1970-01-01 (UTC session)."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def epoch_s(ts) -> Column:
    return F.unix_seconds(col_(ts).cast("timestamp"))


def from_epoch_us(us) -> Column:
    """Microseconds since epoch -> naive timestamp."""
    return F.timestamp_micros(col_(us)).cast("timestamp_ntz")


def floor_to_step(ts, step: str | int) -> Column:
    """Left edge of the fixed bin of width ``step`` holding ``ts`` (epoch aligned)."""
    w = step_us(step)
    return from_epoch_us(F.floor(epoch_us(ts) / F.lit(w)).cast("long") * F.lit(w))


def seconds_of_day(ts) -> Column:
    c = col_(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def hhmm(ts) -> Column:
    return F.date_format(col_(ts), "HH:mm")
