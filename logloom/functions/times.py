"""Timestamp columns: parsing, zone and year decisions, clamps. All results are UTC instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .common import col, let, strip

# Date, optional time with optional fraction, optional offset.
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)$"


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds, with the fraction."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1_000_000.0)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds * 1_000_000).cast("long"))


def utc_instant(wall: Column) -> Column:
    """The text ``YYYY-MM-DD HH:MM:SS[.f]`` read as UTC whatever the session zone; else null."""
    return F.concat(wall, F.lit("+00:00")).try_cast("timestamp")


def iso_struct(c: Column | str) -> Column:
    """ISO text as ``struct(ts, naive)``: the UTC instant (a missing offset read as UTC), or null."""

    def read(text: Column) -> Column:
        naive = (F.length(text) < 17) | ~text.rlike(_OFFSET)
        full = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00Z"))).otherwise(
            F.concat(F.translate(text, ",", "."), F.when(naive, "Z").otherwise(""))
        )
        return F.when(
            text.rlike(_ISO), F.struct(full.try_cast("timestamp").alias("ts"), naive.alias("naive"))
        )

    return let(strip(col(c)), read)


def parse_iso(c: Column | str) -> Column:
    """ISO text as a UTC instant; a missing offset means UTC; null when unreadable."""
    return iso_struct(c)["ts"]


def resolve_naive(ts: Column, received: Column, tz: str) -> Column:
    """A wall clock without an offset (given as if UTC): its reading in ``tz`` or in UTC,
    whichever is nearer the received time, ``tz`` on a tie."""
    local = F.to_utc_timestamp(ts, tz)
    nearer_utc = F.abs(seconds_between(ts, received)) < F.abs(seconds_between(local, received))
    return F.when(nearer_utc, ts).otherwise(local)


def correct_future(ts: Column, received: Column) -> Column:
    """A time more than 300 s ahead is pulled back by whole hours; if still ahead, ``received``."""
    ahead = seconds_between(ts, received)
    hours = F.bround(ahead / 3600, 0)
    moved = F.when(hours > 0, add_seconds(ts, -hours * 3600)).otherwise(ts)
    return F.when(ahead <= fixed.MAX_FUTURE_SECONDS, ts).when(
        seconds_between(moved, received) > fixed.MAX_FUTURE_SECONDS, received
    ).otherwise(moved)


def _tidy_stamp(c: Column) -> Column:
    """Header timestamps in ISO form: slashes, commas and zone names removed."""
    out = F.replace(F.replace(strip(c), F.lit("Z"), F.lit("+00:00")), F.lit("/"), F.lit("-"))
    out = F.regexp_replace(out, r"(?i)\s+(?:UTC|GMT)\b", "+00:00")
    out = F.regexp_replace(out, r"\s+[A-Z]{2,5}(?=$|[+-])", "")
    return F.replace(out, F.lit(","), F.lit("."))


def settle(parts: Column, received: Column, tz: str) -> Column:
    """The instant of an ``iso_struct``: missing offset resolved, future times corrected."""

    def finish(p: Column) -> Column:
        instant = F.when(p["naive"], resolve_naive(p["ts"], received, tz)).otherwise(p["ts"])
        return let(instant, lambda t: correct_future(t, received))

    return let(parts, finish)


def parse_ts(c: Column | str, received: Column | str, tz: str = "UTC") -> Column:
    """A header timestamp as UTC: offsets kept, zone names dropped, missing offset resolved,
    future times corrected; null when unreadable."""
    return settle(iso_struct(_tidy_stamp(col(c))), col(received), tz)


def parse_epoch(c: Column | str, numeric: Column | bool = False) -> Column:
    """Unix time as UTC. Strings need exactly 10 (seconds) or 13 (milliseconds) digits; where
    ``numeric`` is true any number is read, as milliseconds above 1e12."""
    text = strip(col(c).cast("string"))
    value = text.try_cast("double")
    seconds = F.when(value > 1e12, value / 1000).otherwise(value)
    in_range = F.abs(seconds) < 2.5e11
    free = F.when(in_range, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
    digits = F.when(
        text.rlike(r"^(?:[0-9]{10}|[0-9]{13})$"),
        F.when(
            text.cast("string").rlike(r"^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("long"))
        ).otherwise(
            F.when(
                text.try_cast("long") > F.lit(1_000_000_000_000),
                F.timestamp_millis(text.try_cast("long")),
            ).otherwise(F.timestamp_seconds(text.try_cast("long")))
        ),
    )
    flag = F.lit(numeric) if isinstance(numeric, bool) else numeric
    return F.when(flag, free).otherwise(digits)


def infer_year(month: Column, received: Column) -> Column:
    """Year of a date that names none: a month ahead of the received one is last year's, January
    seen in December is next year's."""
    year, now_month = F.year(received), F.month(received)
    return F.when(month > now_month, year - 1).when(
        (now_month == 12) & (month == 1), year + 1
    ).otherwise(year)


def normalize_ts(ts: Column, received: Column) -> Column:
    """Last clamp before storing: unreadable or over 300 s after ``received`` becomes ``received``."""
    return F.when(
        ts.isNull() | (seconds_between(ts, received) > fixed.MAX_FUTURE_SECONDS), received
    ).otherwise(ts)


_CONTAINER_TS = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))(?:\s([^\n]*))?$"


def container_ts(c: Column | str) -> Column:
    """``struct(ts, rest)`` of a container line; ``ts`` is null without an RFC 3339 prefix.

    Fractions are cut, not rounded, to microseconds."""
    line = col(c)

    def read(stamp: Column) -> Column:
        micros = F.regexp_replace(stamp, r"(\.\d{6})\d+", "$1")
        rest = F.when(stamp != "", F.substr(line, F.length(stamp) + 2)).otherwise(line)
        return F.struct(parse_iso(micros).alias("ts"), rest.alias("rest"))

    return let(F.regexp_extract(line, _CONTAINER_TS, 1), read)
