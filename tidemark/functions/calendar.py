"""Time helpers: hours as integers, calendar encodings, local-time flags."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

HOUR = 3600
DAY = 86400


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def epoch_s(ts) -> Column:
    return F.unix_seconds(_c(ts).cast("timestamp"))


def epoch_us(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def day_floor(ts) -> Column:
    return F.date_trunc("day", _c(ts)).cast("timestamp_ntz")


def add_hours(ts, hours) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else _c(hours)
    return F.timestamp_add("HOUR", h, _c(ts))


def to_local(ts, tz: str) -> Column:
    """UTC wall clock to the wall clock of ``tz``."""
    return F.from_utc_timestamp(_c(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def to_utc(ts, tz: str) -> Column:
    """Wall clock of ``tz`` to naive UTC."""
    return F.to_utc_timestamp(_c(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def parse_or_null(text, fmt=None) -> Column:
    """Lenient parse: text that is not a timestamp becomes null."""
    args = [_c(text)] + ([F.lit(fmt)] if fmt else [])
    return F.try_to_timestamp(*args).cast("timestamp_ntz")


def calendar_encoding(valid_ts) -> dict[str, Column]:
    """Sine/cosine of hour of day and day of year, taken at the valid time."""
    day = F.hour(_c(valid_ts)) * F.lit(2 * pi / 24)
    year = F.dayofyear(_c(valid_ts)) * F.lit(2 * pi / 365.25)
    return {
        "hour_sin": F.sin(day), "hour_cos": F.cos(day),
        "year_sin": F.sin(year), "year_cos": F.cos(year),
    }


def is_open(ts, tz="Asia/Shanghai", first=8, last=18, force_closed=False) -> Column:
    """Opening hours in local time; ``force_closed`` switches every hour off."""
    if force_closed:
        return F.lit(False)
    h = F.hour(to_local(ts, tz))
    return (h >= first) & (h < last)


def date_parts(ts) -> dict[str, Column]:
    t = _c(ts)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
            "hour": F.hour(t), "local_date": F.to_date(t)}
