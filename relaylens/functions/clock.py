"""Explicit clocks: every operator takes ``as_of`` instead of reading the wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def instant(as_of: str | datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def shifted(as_of: str | datetime | Column, **units: float) -> Column:
    """``as_of`` moved by days, hours, mins or secs (negative moves back)."""
    parts = {name: F.lit(value) for name, value in units.items()}
    return instant(as_of) + F.make_dt_interval(**parts)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision."""
    micros = [F.unix_micros(edge.cast("timestamp")) for edge in (end, start)]
    return (micros[0] - micros[1]) / F.lit(1_000_000)


def next_reset(ts: Column, hour: Column | int = 0, zone: Column | str = "UTC") -> Column:
    """The first moment after ``ts`` at which the local clock in ``zone`` shows ``hour``:00."""
    hour = hour if isinstance(hour, Column) else F.lit(hour)
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    utc = F.lit("UTC")
    local = F.convert_timezone(utc, zone, ts.cast("timestamp_ntz"))
    today = (F.date_trunc("day", local).cast("timestamp_ntz") + F.make_dt_interval(hours=hour))
    upcoming = F.when(today <= local, today + F.make_dt_interval(days=F.lit(1))).otherwise(today)
    return F.convert_timezone(zone, utc, upcoming)
