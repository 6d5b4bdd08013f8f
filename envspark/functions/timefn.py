"""Time helpers: look-back parsing, period buckets and labels, calendar
features, ISO parsing (C1-C3, F7, F13)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = re.compile(r"^\s*(\d+)\s*([hd])\s*$")


def parse_time_range(s: str | None, default: str | None = "7d") -> dt.timedelta:
    """``'<n>h'`` / ``'<n>d'`` -> timedelta.  Anything else falls back to
    ``default``; with ``default=None`` a bad value raises ``ValueError``."""
    m = _RANGE.match(s or "")
    if not m:
        if default is None:
            raise ValueError(f"Invalid time_range {s!r}. Use format like '24h' or '7d'")
        return parse_time_range(default, None)
    n, unit = int(m.group(1)), m.group(2)
    return dt.timedelta(hours=n) if unit == "h" else dt.timedelta(days=n)


def as_timestamp(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value).replace("Z", "+00:00")).replace(tzinfo=None)


def ts_lit(value) -> Column:
    """A ``timestamp_ntz`` literal (timestamps at rest carry no zone)."""
    return F.lit(as_timestamp(value)).cast("timestamp_ntz")


def look_back(as_of, time_range: str | None, default: str | None = "7d") -> tuple[dt.datetime, dt.datetime]:
    """(start, end) of a look-back window ending at ``as_of``."""
    end = as_timestamp(as_of)
    return end - parse_time_range(time_range, default), end


def scene_interval(as_of, days_back: int = 30) -> tuple[dt.datetime, dt.datetime]:
    """the scene search interval ``[as_of - days_back, as_of]``."""
    end = as_timestamp(as_of)
    return end - dt.timedelta(days=days_back), end


_UNITS = {"minute", "hour", "day", "week", "month"}


def time_bucket(ts: Column | str, unit: str) -> Column:
    """Truncate to minute/hour/day/week (Monday)/month, kept as NTZ."""
    if unit not in _UNITS:
        raise ValueError(f"Invalid period {unit!r}. Must be one of: {sorted(_UNITS)}")
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def iso_week_label(ts: Column) -> Column:
    """ISO ``YYYY-WW``: week-year is the year of the week's Thursday."""
    thursday = F.date_add(F.to_date(ts), 3 - (F.dayofweek(ts) + 5) % 7)
    return F.concat(F.year(thursday).cast("string"), F.lit("-"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def period_label(ts: Column, unit: str) -> Column:
    """Labels for bucket starts, as the dashboard prints them."""
    if unit == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00:00")
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "week":
        return iso_week_label(ts)
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    if unit == "minute":
        return F.date_format(ts, "yyyy-MM-dd HH:mm:00")
    raise ValueError(f"Invalid group_by {unit!r}")


def calendar_features(ts: Column | str) -> dict[str, Column]:
    """Hour, day_of_week (Monday=0), day_of_month, month, is_weekend."""
    c = F.col(ts) if isinstance(ts, str) else ts
    dow = F.weekday(c)
    return {
        "hour": F.hour(c).cast("int"),
        "day_of_week": dow.cast("int"),
        "day_of_month": F.dayofmonth(c).cast("int"),
        "month": F.month(c).cast("int"),
        "is_weekend": dow >= 5,
    }


def parse_iso(s: Column | str) -> Column:
    """ISO-8601 text (optional ``T``, fraction, ``Z``/offset) -> NTZ, null if bad."""
    c = F.col(s) if isinstance(s, str) else s
    t = F.trim(c)
    with_zone = F.try_to_timestamp(t)  # handles Z and +hh:mm offsets, converted to UTC
    return F.coalesce(F.try_to_timestamp(t).cast("timestamp_ntz"),
                      with_zone.cast("timestamp_ntz"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 (double) of an NTZ/UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def from_epoch_seconds(sec: Column) -> Column:
    return F.timestamp_micros((sec * 1_000_000).cast("long")).cast("timestamp_ntz")


_FREQ = re.compile(r"^\s*(\d*)\s*(s|sec|second|seconds|t|min|minute|minutes|h|hour|hours|d|day|days)\s*$", re.I)
_FREQ_SEC = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "t": 60, "min": 60, "minute": 60,
             "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400,
             "days": 86400}


def freq_seconds(freq: str | int | dt.timedelta) -> int:
    """``'1H'``, ``'15T'``, ``'15min'``, ``'6 hours'``, ``'1D'`` -> seconds."""
    if isinstance(freq, dt.timedelta):
        return int(freq.total_seconds())
    if isinstance(freq, int):
        return freq
    m = _FREQ.match(freq)
    if not m:
        raise ValueError(f"Unsupported frequency {freq!r}")
    return int(m.group(1) or 1) * _FREQ_SEC[m.group(2).lower()]
