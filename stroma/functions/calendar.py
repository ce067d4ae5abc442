"""Time expressions. Timestamps are without zone and in UTC unless a zone is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.to_utc_timestamp(ts, "UTC"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(ts: Column | str, minutes: int) -> Column:
    """Start of the left-closed window of ``minutes`` that holds the time."""
    step = minutes * 60 * MICROS
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(step)))


def ceil_to(ts: Column | str, minutes: int) -> Column:
    """Label of the right-closed, right-labelled window of ``minutes`` that holds the time."""
    step = minutes * 60 * MICROS
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(step)))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Exact difference in minutes, as double."""
    return (micros(later) - micros(earlier)) / F.lit(60.0 * MICROS)


def to_local(ts: Column, zone: str) -> Column:
    """Local clock time of a UTC time."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def to_utc(local: Column, zone: str, strict: bool = True) -> Column:
    """UTC of a local clock time; with ``strict``, NULL where the clock shows it never or twice."""
    once = F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")
    if not strict:
        return once
    hour = F.expr("INTERVAL 1 HOUR")
    back = to_local(once, zone) == local
    twice = (to_local(once - hour, zone) == local) | (to_local(once + hour, zone) == local)
    return F.when(back & ~twice, once)


def operating_day(local: Column, hours: int = 3) -> Column:
    """Date of the operating day, which begins ``hours`` after midnight."""
    return (local - F.expr(f"INTERVAL {hours} HOURS")).cast("date")


def weekday(ts: Column | str) -> Column:
    """1 (Monday) to 7 (Sunday)."""
    return (F.weekday(ts) + 1).cast("int")


def day_type(ts: Column, holidays: list[str] | None = None) -> Column:
    """``workday`` (Monday to Thursday), ``friday``, ``saturday`` or ``sunday`` (with the given holidays)."""
    day = F.weekday(ts)
    free = F.date_format(ts, "yyyy-MM-dd").isin(holidays) if holidays else F.lit(False)
    return F.when((day == 6) | free, "sunday").when(day == 5, "saturday").when(day == 4, "friday").otherwise("workday")


def rush_hour(ts: Column, hours: tuple[int, ...] = (6, 7, 8, 9, 15, 16, 17, 18, 19)) -> Column:
    return F.hour(ts).isin(*hours)
