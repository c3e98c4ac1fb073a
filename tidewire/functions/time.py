"""Calendar days of the product's zone and report periods."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def local_day(ts: Column) -> Column:
    """The local calendar date of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def window_start(now: datetime, hours: int) -> datetime:
    """Start (naive UTC) of a window that ends at ``now`` (naive UTC).

    Whole days are local calendar days, today included; other lengths roll.
    """
    if hours % 24:
        return now - timedelta(hours=hours)
    zone, utc = ZoneInfo(ZONE), ZoneInfo("UTC")
    day = now.replace(tzinfo=utc).astimezone(zone).date() - timedelta(days=max(hours // 24, 1) - 1)
    return datetime.combine(day, time.min, tzinfo=zone).astimezone(utc).replace(tzinfo=None)


def day_bounds(start: date, end: date) -> tuple[datetime, datetime]:
    """UTC bounds (start, before) of the local days from ``start`` to ``end``."""
    zone, utc = ZoneInfo(ZONE), ZoneInfo("UTC")
    bound = lambda d: datetime.combine(d, time.min, tzinfo=zone).astimezone(utc).replace(tzinfo=None)
    return bound(start), bound(end + timedelta(days=1))


def period_key(kind: str, day: Column) -> Column:
    """``2026-W53`` or ``2026-12``."""
    if kind == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if kind == "monthly":
        return F.date_format(day, "yyyy-MM")
    raise ValueError(f"unknown period kind: {kind}")


def period_range(kind: str, key: str) -> tuple[date, date]:
    """First and last day of a period."""
    try:
        if kind == "weekly":
            year, week = key.split("-W")
            return date.fromisocalendar(int(year), int(week), 1), date.fromisocalendar(int(year), int(week), 7)
        if kind == "monthly":
            year, month = map(int, key.split("-"))
            first = date(year, month, 1)
            return first, date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    except (ValueError, AttributeError) as error:
        raise ValueError(f"invalid {kind} key: {key!r}") from error
    raise ValueError(f"unknown period kind: {kind}")
