"""Time helpers: buckets, strict look-back bounds, feed dates, epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_col(as_of=None) -> Column:
    """`as_of` as a timestamp column; None means the query's current time."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def hours_before(as_of, hours) -> Column:
    return as_of_col(as_of) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def minutes_before(as_of, minutes) -> Column:
    return as_of_col(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)))


def seconds_after(ts, seconds) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(seconds) if not isinstance(seconds, int) else F.lit(seconds))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
# FIXED VALUES: buckets are counted from Monday 2000-01-03 00:00 UTC.
BUCKET_ORIGIN_SECONDS = 946_857_600


def width_seconds(width: str) -> int:
    """Seconds of a width such as "10 seconds", "1 hour" or "7 days"."""
    n, unit = width.split()
    return int(n) * _UNIT_SECONDS[unit.rstrip("s")]


def bucket_window(ts, width: str = "10 seconds") -> Column:
    """The tumbling window holding ts, counted from BUCKET_ORIGIN_SECONDS: windows count from the epoch
    unless told otherwise, which shifts widths that do not divide the distance (weeks begin on Thursday)."""
    w = width_seconds(width)
    return F.window(_c(ts), f"{w} seconds", f"{w} seconds", f"{BUCKET_ORIGIN_SECONDS % w} seconds")


def time_bucket(ts, width: str = "10 seconds") -> Column:
    """Start of the tumbling bucket holding ts."""
    return bucket_window(ts, width).start


# Feed date layouts tried in order: RFC 822 (one- or two-digit day, optional
# seconds, numeric offset, zone name or none, four- or two-digit year), then RFC 3339
# and its usual relatives (optional seconds and fraction; Z, numeric offset or none;
# a space for the T; a date alone). A date without a zone is UTC.
FEED_DATE_PATTERNS = (
    "d MMM yyyy HH:mm[:ss] Z", "d MMM yyyy HH:mm[:ss] z", "d MMM yyyy HH:mm[:ss]", "d MMM yyyy",
    "d MMM yy HH:mm[:ss] Z", "d MMM yy HH:mm[:ss] z", "d MMM yy HH:mm[:ss]", "d MMM yy",
    "yyyy-MM-dd['T'][ ]HH:mm[:ss][.SSSSSSSSS]XXX", "yyyy-MM-dd['T'][ ]HH:mm[:ss][.SSSSSSSSS]XX",
    "yyyy-MM-dd['T'][ ]HH:mm[:ss][.SSSSSSSSS]", "yyyy-MM-dd",
)


def feed_timestamp(s) -> Column:
    """RFC 822 / RFC 3339 feed date -> timestamp; NULL if unparsable.
    The weekday (short or in full) is dropped first: Spark's parser rejects pattern letter E."""
    t = F.regexp_replace(F.trim(_c(s)), r"^[A-Za-z]+,?\s+(?=\d)", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in FEED_DATE_PATTERNS])


def epoch_timestamp(seconds) -> Column:
    return F.timestamp_seconds(_c(seconds))


def seconds_between(a, b) -> Column:
    """b - a in (fractional) seconds."""
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / F.lit(1e6)
