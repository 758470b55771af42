"""Column functions on times: local wall clock, service days, minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
RAW_FORMAT = "yyMMddHHmm"


def raw_to_utc(raw: Column, zone: str = ZONE) -> Column:
    """yyMMddHHmm on a local clock -> instant; null where it isn't a time. The repeated hour counts as its first pass."""
    valid = F.when(raw.rlike("^[0-9]{10}$"), raw)
    return F.to_utc_timestamp(F.try_to_timestamp(valid, F.lit(RAW_FORMAT)), zone)


def is_ambiguous(raw: Column, zone: str = ZONE) -> Column:
    """Whether a raw local time names an hour that the clock change repeats or skips; false where it isn't a time."""
    local = F.try_to_timestamp(F.when(raw.rlike("^[0-9]{10}$"), raw), F.lit(RAW_FORMAT))
    utc = F.to_utc_timestamp(local, zone)
    repeated = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone) == local
    skipped = F.from_utc_timestamp(utc, zone) != local
    return F.coalesce(repeated | skipped, F.lit(False))


def service_day(t: Column, start_hour: int = 4, zone: str = ZONE) -> Column:
    """The day a time belongs to when days begin at `start_hour` local time."""
    return F.to_date(F.from_utc_timestamp(t, zone) - F.expr(f"INTERVAL {start_hour} HOURS"))


def day_start(day: Column, start_hour: int = 4, zone: str = ZONE) -> Column:
    """The instant a service day begins; days of clock changes have 23 or 25 hours."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"INTERVAL {start_hour} HOURS"), zone)


def minutes(later: Column, earlier: Column) -> Column:
    """Minutes between two timestamps, with their fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def shifted(t: Column, by_minutes: Column | float) -> Column:
    by = by_minutes if isinstance(by_minutes, Column) else F.lit(by_minutes)
    return F.timestamp_micros(F.unix_micros(t) + F.round(by * F.lit(6e7)).cast("long"))


def floor_to(t: Column, step_minutes: int) -> Column:
    """The last mark of a grid of `step_minutes` at or before t."""
    step = step_minutes * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(t) / F.lit(step).cast("decimal(20,0)")).cast("long") * step)


def ceil_to(t: Column, step_minutes: int) -> Column:
    """The first mark of a grid of `step_minutes` at or after t."""
    return floor_to(F.timestamp_micros(F.unix_micros(t) + F.lit(step_minutes * 60_000_000 - 1).cast("long")), step_minutes)


def minute_mark(t: Column) -> Column:
    return F.date_trunc("minute", t)


def local_iso(t: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(t, zone), "yyyy-MM-dd'T'HH:mm:ss")
