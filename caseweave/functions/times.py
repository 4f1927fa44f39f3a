"""Time arithmetic as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds, with fractions."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1_000_000.0)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def days_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def boundaries(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of ``unit`` boundaries crossed, so 00:59 to 02:01 is 2 hours."""
    if unit == "day":
        return F.datediff(_col(end), _col(start)).cast("bigint")
    return F.timestamp_diff(
        unit.upper(), F.date_trunc(unit, _col(start)), F.date_trunc(unit, _col(end))
    )


def plus_hours(start: Column | str, hours: float) -> Column:
    return _col(start) + F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(hours * 3600.0))


WINDOW_TEXT = re.compile(r"(\d+)\s*(h(?:ours?)?|d(?:ays?)?|m(?:in(?:utes?)?)?)")
UNIT_HOURS = {"h": 1.0, "d": 24.0, "m": 1.0 / 60.0}


def window_hours(text: str) -> float:
    """Length in hours of a window written as ``48h``, ``7d`` or ``30m``."""
    found = WINDOW_TEXT.match(text.lower().strip())
    if found is None:
        raise ValueError(f"not a time window: {text}")
    return int(found.group(1)) * UNIT_HOURS[found.group(2)[0]]
