"""Column functions over instants: slots, seasons, formatting. All work in whole microseconds, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_US = 86_400 * MICROS


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp (or of a timestamp without zone, read as UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def instant(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def iso_utc(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_utc_us(us: Column) -> Column:
    return iso_utc(instant(us))


def floor_us(us: Column, step_us: int) -> Column:
    """The greatest multiple of ``step_us`` not above ``us``; right for negative values too."""
    return us - F.pmod(us, F.lit(step_us).cast("long"))


def slot_end_us(us: Column, slot_min: int = 10) -> Column:
    """End of the half-open slot ``(end - slot, end]`` that holds the instant: a boundary is its own end."""
    s = slot_min * 60 * MICROS
    return us + F.pmod(-us, F.lit(s).cast("long"))


def nearest_mark_us(us: Column, step_us: int) -> Column:
    """The nearest multiple of ``step_us``; exactly half way goes to the later mark."""
    return floor_us(us + F.lit(step_us // 2).cast("long"), step_us)


def rounded_slot_sec(sec: Column, slot_min: int = 10) -> Column:
    """Nearest slot in seconds, halves to the even slot (the rule of the gauge join)."""
    s = slot_min * 60
    return (F.bround(sec / F.lit(float(s))) * s).cast("long")


def meteorological_season(month: Column) -> Column:
    """DJF, MAM, JJA, SON: the season of the reports."""
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .when(month.isin(9, 10, 11), "SON")
    )


def convective_season(month: Column) -> Column:
    """summer (5-9), winter (12-3), shoulder: the season of thresholds and features."""
    return F.when(month.between(5, 9), "summer").when(month.isin(12, 1, 2, 3), "winter").when(month.isNotNull(), "shoulder")
