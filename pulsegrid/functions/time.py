"""Clock arithmetic on timestamps, kept exact by working in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def us(ts) -> Column:
    """Microseconds since the epoch as a BIGINT."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_us(value) -> Column:
    """Inverse of :func:`us`, as a zone-less timestamp."""
    return F.timestamp_micros(col(value)).cast("timestamp_ntz")


def floor_div(value, size: int) -> Column:
    """Whole-number division rounding down, also for negative values."""
    v = col(value)
    return ((v - F.pmod(v, F.lit(size).cast("bigint"))) / F.lit(size)).cast("bigint")


def bucket(ts, seconds: float, origin_us: int = 0) -> Column:
    """Number of the ``seconds``-long bucket holding ``ts`` (FN-1)."""
    return floor_div(us(ts) - F.lit(origin_us), int(seconds * SECOND))


def truncate(ts, minutes: int) -> Column:
    """Start of the N-minute bucket as a timestamp (FN-1)."""
    size = minutes * MINUTE
    return from_us(floor_div(us(ts), size) * F.lit(size))


def day_number(ts) -> Column:
    return floor_div(us(ts), DAY)


def minute_of_day(ts) -> Column:
    return floor_div(F.pmod(us(ts), F.lit(DAY)), MINUTE).cast("int")


def clock_hour(ts, wrap: bool = False) -> Column:
    """Hour of day with fraction; with ``wrap`` noon and later turn negative (FN-2)."""
    hour = F.hour(col(ts)) + F.minute(col(ts)) / F.lit(60.0)
    return F.when(hour >= 12, hour - 24).otherwise(hour) if wrap else hour


def shift_window(ts, shift, first_hour: int = 5, last_hour: int = 23):
    """Nominal shift around an event: ``(start_us, end_us)`` columns (FN-3).

    Day shifts run 07-19 of the event's date when ``first_hour <= hour <=
    last_hour``.  Night shifts run 19-07, from the event's date for hours from
    16 on and from the date before for hours up to 12.
    """
    hour, day0 = F.hour(col(ts)), day_number(ts) * F.lit(DAY)
    is_day = col(shift) == "day"
    start = (
        F.when(is_day & hour.between(first_hour, last_hour), day0 + 7 * HOUR)
        .when(~is_day & (hour >= 16), day0 + 19 * HOUR)
        .when(~is_day & (hour <= 12), day0 - 5 * HOUR)
    )
    return start, start + F.lit(12 * HOUR)


def relative_hour(ts, session_start) -> Column:
    """Hours since the nominal shift start of the recording's first sample (FN-4).

    A recording that starts before 05:00 belongs to the night shift begun at
    19:00 the evening before, one from 18:00 on to the 19:00 shift of its own
    date, any other to the 07:00 shift.
    """
    hour, day0 = F.hour(col(session_start)), day_number(session_start) * F.lit(DAY)
    begin = (
        F.when(hour <= 4, day0 - 5 * HOUR).when(hour > 17, day0 + 19 * HOUR).otherwise(day0 + 7 * HOUR)
    )
    return (us(ts) - begin) / F.lit(float(HOUR))


def to_local(ts, zone: str) -> Column:
    """UTC wall time to local wall time (SRC-12)."""
    return F.from_utc_timestamp(col(ts), zone)


def to_unix(ts) -> Column:
    return floor_div(us(ts), SECOND)


def from_unix(seconds) -> Column:
    return from_us(col(seconds) * F.lit(SECOND))
