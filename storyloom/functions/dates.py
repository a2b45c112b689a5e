"""Dates of feeds. All times are UTC without zone; 'now' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of feeds, in the order in which they are tried.
ZONED = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss z"]
PLAIN = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"]
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def from_micros(value: Column) -> Column:
    """The time without zone of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", value, F.expr(EPOCH))


def literal(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def parse(text: Column) -> Column:
    """Microseconds since 1970 of a feed's date; null if no format fits. A date without zone is UTC."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = [F.unix_micros(F.try_to_timestamp(bare, F.lit(f))) for f in ZONED]
    plain = [F.unix_micros(F.try_to_timestamp(F.concat(bare, F.lit(" +0000")), F.lit(f"{f} XX"))) for f in PLAIN]
    return F.coalesce(*zoned, *plain)


def age_hours(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, now) / 3.6e9


def recent(ts: Column, now: Column, hours: int) -> Column:
    """At most ``hours`` old, that age included."""
    return ts >= now - F.expr(f"interval {hours} hours")


def parse_relative(text: Column, now: Column) -> Column:
    """The time that '3 hours ago', 'yesterday' or 'today' means."""
    low = F.lower(F.trim(text))
    out = None
    for unit, seconds in (("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800)):
        n = F.regexp_extract(low, rf"(\d+)\s*{unit}?s?\s*ago", 1)
        value = now - F.make_dt_interval(secs=F.try_to_number(n, F.lit("999999999")).cast("long").cast("decimal(18,6)") * seconds)
        out = F.when(n != "", value) if out is None else out.when(n != "", value)
    return out.when(F.contains(low, F.lit("yesterday")), now - F.expr("interval 1 day")).when(F.contains(low, F.lit("today")), now)


def taiwan(ts: Column) -> Column:
    return ts + F.expr("interval 8 hours")


def to_utc(ts: Column, offset_hours: Column, now: Column) -> Column:
    """A local time with its offset (null: none given, so UTC) as UTC; a missing time is now."""
    return F.coalesce(ts - F.make_dt_interval(hours=F.coalesce(offset_hours, F.lit(0))), now)


def format_feed(ts: Column) -> Column:
    """A time the way feeds show it."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
