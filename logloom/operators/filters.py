"""Filters over log rows as Columns, and the combined filter that search, count and delete share."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.common import col
from ..functions.patterns import split_list
from ..functions.text import WORD_CLASS, fold, term_words
from ..session import join_dimension

if TYPE_CHECKING:
    from .textquery import TextQuery

# Names of the searchable fields and their short forms.
SEARCH_FIELDS = ("app_name", "source_alias", "message")
FIELD_NAMES = {
    "app": ("app_name",),
    "app_name": ("app_name",),
    "host": ("source_alias",),
    "source": ("source_alias",),
    "source_alias": ("source_alias",),
    "msg": ("message",),
    "message": ("message",),
}
LIVE_FIELDS = (*SEARCH_FIELDS, "source_ip")

# Lists longer than this are joined instead of compared one by one.
IN_LIST_MAX = 500


def severity_max(n: int) -> Column:
    return F.col("severity") <= n


def apps(names: list[str]) -> Column:
    return F.col("app_name").isin(*names) if names else F.lit(True)


def is_container_row(container_aliases: list[str]) -> Column:
    """Whether a row is container output: by source address or by a container host's alias."""
    names = sorted({fixed.CONTAINER_SOURCE, *container_aliases})
    return (F.col("source_ip") == fixed.CONTAINER_SOURCE) | F.coalesce(
        F.col("source_alias").isin(*names), F.lit(False)
    )


def sources(names: list[str], container_aliases: list[str] = ()) -> Column:
    """Rows of the hosts: alias in the list, or address in the list unless container output."""
    if not names:
        return F.lit(True)
    by_ip = F.col("source_ip").isin(*names) & ~is_container_row(list(container_aliases))
    return F.coalesce(F.col("source_alias").isin(*names), F.lit(False)) | by_ip


def in_table(logs: DataFrame, c: str, names: DataFrame) -> DataFrame:
    """Rows whose column value is in a one-column table of any length."""
    return join_dimension(logs, names.toDF(c).distinct(), [c], "left_semi")


# Units of relative times, in seconds.
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_RELATIVE = re.compile(
    r"(\d+)\s*(s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|"
    r"d|day|days|w|week|weeks)",
    re.IGNORECASE,
)


def resolve_bound(value, as_of: dt.datetime, tz: str = "UTC") -> dt.datetime | None:
    """A time bound as a UTC datetime: relative (``15m``, ``7d``), ``today``, ``yesterday``
    (midnight in ``tz``), ISO text or a datetime."""
    if value is None or value == "":
        return None
    utc = dt.timezone.utc
    as_of = as_of.replace(tzinfo=utc) if as_of.tzinfo is None else as_of.astimezone(utc)
    if isinstance(value, (int, float)):
        return dt.datetime.fromtimestamp(value, tz=utc)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=utc) if value.tzinfo is None else value.astimezone(utc)
    text = str(value).strip()
    days_back = {"today": 0, "since_midnight": 0, "yesterday": 1}.get(text.lower())
    if days_back is not None:
        zone = ZoneInfo(tz)
        day = as_of.astimezone(zone).date() - dt.timedelta(days=days_back)
        return dt.datetime.combine(day, dt.time(), tzinfo=zone).astimezone(utc)
    if m := _RELATIVE.fullmatch(text):
        return as_of - dt.timedelta(seconds=int(m[1]) * _UNITS[m[2][0].lower()])
    try:
        return resolve_bound(dt.datetime.fromisoformat(text.replace("Z", "+00:00")), as_of)
    except ValueError:
        raise ValueError(f"not a time: {value!r} (use 15m, 24h, 7d, today or ISO 8601)") from None


def _instant(value: dt.datetime) -> Column:
    micros = round(value.timestamp() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def time_range(
    start=None, end=None, as_of: dt.datetime | None = None, tz: str = "UTC", log_date: bool = False
) -> Column:
    """Rows from ``start`` to ``end``, both included. ``log_date`` adds the same bounds on the
    partition column, so whole days are never listed."""
    as_of = as_of or dt.datetime.now(dt.timezone.utc)
    out = F.lit(True)
    lo, hi = resolve_bound(start, as_of, tz), resolve_bound(end, as_of, tz)
    if lo is not None:
        out = out & (F.col("timestamp") >= _instant(lo))
        out = out & (F.col("log_date") >= F.lit(lo.date())) if log_date else out
    if hi is not None:
        out = out & (F.col("timestamp") <= _instant(hi))
        out = out & (F.col("log_date") <= F.lit(hi.date())) if log_date else out
    return out


def _phrase(c: Column, tokens: list[str], prefix: bool) -> Column:
    """Consecutive words in one text; the last may be the start of a longer word."""
    if not tokens:
        return F.lit(True)
    text = fold(F.coalesce(c, F.lit("")))
    gap = f"[^{WORD_CLASS}]+"
    tail = "" if prefix else f"(?![{WORD_CLASS}])"
    pattern = f"(?<![{WORD_CLASS}])" + gap.join(tokens) + tail
    return text.contains(tokens[0]) & text.rlike(pattern)


def _fields(name: str | None, live: bool) -> tuple[str, ...]:
    if name is None:
        return LIVE_FIELDS if live else SEARCH_FIELDS
    found = FIELD_NAMES[name.lower()]
    return (*found, "source_ip") if live and found == ("source_alias",) else found


def has_term(term: str, field: str | None = None, live: bool = False) -> Column:
    """Rows with the term in one of the searchable fields (or the named one).

    A term of 3 or more characters, or one ending in ``*``, matches the start of a word; shorter
    ones match whole words. A term of several words (an address) matches them in a row.
    """
    prefix = term.endswith("*") or len(term) >= fixed.TERM_PREFIX_MIN_CHARS
    tokens = term_words(term)
    out = F.lit(False)
    for f in _fields(field, live):
        out = out | _phrase(F.col(f), tokens, prefix)
    return out


def has_phrase(
    phrase: str, field: str | None = None, live: bool = False, prefix: bool = False
) -> Column:
    """Rows with the phrase's words in a row inside one field."""
    tokens = term_words(phrase)
    out = F.lit(False)
    for f in _fields(field, live):
        out = out | _phrase(F.col(f), tokens, prefix)
    return out


def all_of(*conds: Column) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def any_of(*conds: Column) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def none_of(*conds: Column) -> Column:
    """``a NOT b``: combine as ``all_of(a, none_of(b))``."""
    return ~F.coalesce(any_of(*conds), F.lit(False))


@dataclass
class LogFilter:
    """Criteria of a search, count or delete; empty criteria match everything."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    not_terms: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    severity_max: int | None = None
    start: object = None
    end: object = None
    ids: list[int] = field(default_factory=list)
    container_aliases: list[str] = field(default_factory=list)
    as_of: dt.datetime | None = None
    tz: str = "UTC"
    log_date: bool | None = None  # None: bound the days whenever the rows have a ``log_date``
    text: TextQuery | None = None  # any combination of words and phrases

    def is_empty(self) -> bool:
        return not (
            self.terms or self.phrases or self.not_terms or self.sources or self.apps or self.ids
            or self.severity_max is not None or self.start or self.end or self.text is not None
        )


def log_filter(spec: LogFilter, live: bool = False) -> Column:
    """All criteria as one condition; cheap ones come first."""
    conds = [time_range(spec.start, spec.end, spec.as_of, spec.tz, bool(spec.log_date))]
    if spec.ids:
        conds.append(F.col("id").isin(*spec.ids))
    if spec.severity_max is not None:
        conds.append(severity_max(spec.severity_max))
    if spec.apps:
        conds.append(apps(spec.apps))
    if spec.sources:
        conds.append(sources(spec.sources, spec.container_aliases))
    conds += [has_term(t, live=live) for t in spec.terms]
    conds += [has_phrase(p, live=live) for p in spec.phrases]
    conds += [none_of(has_term(t, live=live)) for t in spec.not_terms]
    if spec.text is not None:
        conds.append(spec.text.condition(live))
    return all_of(*conds)


def matching(logs: DataFrame, spec: LogFilter) -> DataFrame:
    """The rows of a filter. Time bounds also bound ``log_date`` where the rows have it."""
    if spec.log_date is None:
        spec = replace(spec, log_date="log_date" in logs.columns)
    return logs.filter(log_filter(spec))


def live_filter(
    severity: int | None = None,
    hosts: list[str] = (),
    app_names: list[str] = (),
    container_aliases: list[str] = (),
) -> Column:
    """The filter of the moving stream; container rows match hosts by alias only."""
    spec = LogFilter(
        severity_max=severity,
        sources=list(hosts),
        apps=list(app_names),
        container_aliases=list(container_aliases),
    )
    return log_filter(spec)


def excluded_container(
    excluded: str | list[str], cid: Column | str, name: Column | str, display: Column | str
) -> Column:
    """Whether a container is on the exclusion list by name, display name, id or short id."""
    names = split_list(excluded)
    if not names:
        return F.lit(False)
    cid = F.lower(col(cid))
    keys = [
        F.regexp_replace(F.lower(col(name)), "^/+", ""),
        F.regexp_replace(F.lower(col(display)), "^/+", ""),
        cid,
        F.left(cid, F.lit(12)),
    ]
    return any_of(*[F.coalesce(k.isin(*names), F.lit(False)) for k in keys])


def exclude_containers(
    df: DataFrame,
    excluded: str | list[str],
    cid: str = "container_id",
    name: str = "container_name",
    display: str = "display_name",
) -> DataFrame:
    return df.filter(~excluded_container(excluded, cid, name, display))
