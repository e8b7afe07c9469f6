"""Widths of time and epoch-aligned floors."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_UNIT_US = {
    "us": 1, "microsecond": 1, "ms": 1_000, "millisecond": 1_000, "s": 1_000_000, "second": 1_000_000,
    "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
}


def width_us(width: str | int) -> int:
    """'1s', '5 minutes', '1 day' ... as microseconds; an int is taken as microseconds already."""
    if isinstance(width, int):
        return width
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", width.lower())
    unit = match and (match[2] if match[2] in _UNIT_US else match[2].removesuffix("s"))
    if not match or unit not in _UNIT_US:
        raise ValueError(f"not a time width: {width!r}")
    return int(match[1]) * _UNIT_US[unit]


def floor_us(us: Column, width: str | int) -> Column:
    """Start of the epoch-aligned window that holds ``us``, in microseconds."""
    return us - F.pmod(us, F.lit(width_us(width)))


def floor_time(ts: Column, width: str | int) -> Column:
    """The same as a timestamp; equals ``F.window(ts, width).start`` but keeps rows without a time."""
    return F.timestamp_micros(floor_us(F.unix_micros(ts), width))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)
