"""Timestamps and day stamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_api_time(c) -> Column:
    """Parse ``yyyy-MM-ddTHH:mm:ssZ`` and ``yyyy-MM-ddTHH:mm:ss.ffffffZ`` (UTC).

    Unparseable text gives NULL rather than failing the job.
    """
    col = c if isinstance(c, Column) else F.col(c)
    return F.try_to_timestamp(col)


def day_text(c) -> Column:
    """``yyyy-MM-dd`` of a timestamp."""
    return F.date_format(c, "yyyy-MM-dd")


def day_stamp(c) -> Column:
    """``yyyyMMdd`` of a timestamp or date."""
    return F.date_format(c, "yyyyMMdd")


def stamp_of(day: str) -> str:
    """``yyyy-MM-dd`` -> ``yyyyMMdd`` (driver-side parameter only)."""
    return dt.date.fromisoformat(day).strftime("%Y%m%d")


def lookback_stamps(day: str, lookback_days: int = 1) -> list[str]:
    """Day stamps of the look-back window, newest first (a job parameter)."""
    d = dt.date.fromisoformat(day)
    return [(d - dt.timedelta(days=i)).strftime("%Y%m%d") for i in range(lookback_days)]


def lookback_stamps_col(day, lookback_days: int = 1) -> Column:
    """Column form of the look-back window: ``yyyyMMdd`` stamps of the
    ``lookback_days`` days ending at ``day`` (a date column), newest first."""
    d = day if isinstance(day, Column) else F.col(day)
    days = F.reverse(F.sequence(F.date_sub(d, lookback_days - 1), d))
    return F.transform(days, lambda x: F.date_format(x, "yyyyMMdd"))
