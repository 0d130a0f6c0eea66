"""Syslog lines parsed into log rows, over a text table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.common import let, lookup
from ..functions.severity import PRI_PATTERN, content_severity, severity_of_name
from ..functions.structured import SD_RUN
from ..functions.text import cap_text, longer_than
from ..functions.times import (
    correct_future,
    infer_year,
    iso_struct,
    normalize_ts,
    parse_ts,
    resolve_naive,
    settle,
    utc_instant,
)

# Header shapes of syslog lines, in the order they are tried.
_ISO = (
    r"(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r"(?:\s+(?:UTC|GMT|CET|EET|WET|MSK|[A-Z]{1,2}[SD]T)(?:[+-]\d{1,4})?|Z|[+-]\d{2}:?\d{2})?)"
)
BSD = r"(?s)^([A-Z][a-z]{2})\s+(\d+)\s+(\d{2}):(\d{2}):(\d{2})\s+(.*)"
BRACKET_ISO = rf"(?s)^\[{_ISO}\]\s*(.*)"
PLAIN_ISO = rf"(?s)^{_ISO}\s+(.*)"
VALKEY = (
    r"(?s)^(\d+:[a-zA-Z])\s+(\d{1,2})\s+([A-Z][a-z]{2})\s+(\d{4})\s+"
    r"(\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([#*.-])\s+(.*)"
)
APP_PIPE = r"(?s)^\[([^\]]+)\]\s*\|\s*(\d{2}/\d{2}/\d{4})\s+(\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+(.*)"
LOGFMT = r"""(?s)^(?:time|ts)=["']?([^"'\s]+)["']?\s+(.*)"""
LOGFMT_LEVEL = r"""\b(?:level|lvl|severity)=["']?([a-zA-Z]+)["']?"""
LOGFMT_MSG = r"""\bmsg=("[^"]*"|'[^']*'|\S+)"""
BRACKET_LEVEL = r"(?s)^\[([a-zA-Z]+)\]\s*(.*)"

# Forms of the host, app and process id before the message.
_HOST_APP = r"(?s)^\[([^\]]+)\]\s+\[([^\]]+)\]\s*(.*)"
_HOST_ONLY = r"(?s)^\[([^\]]+)\]\s*(.*)"
_TAG_COLON = r"(?s)^([^:\s\[]+?)(?:\[\d+\])?:\s*(.*)"
_TAG_PID = r"(?s)^([^:\s\[]+)\[\d+\]\s+(.*)"
_TAG_BRACKET = r"(?s)^\[([^\]]+)\]:?\s*(.*)"
_TAG_SPACE = r"(?s)^([^:\s]+)\s+(.*)"

FORMATS = (
    "rfc5424", "rfc5424_short", "rfc3164", "bracket_iso", "iso", "valkey", "app_pipe", "logfmt", "plain",
)


def _is_level(name: Column) -> Column:
    return severity_of_name(name).isNotNull()


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def syslog_format(content: Column) -> Column:
    """The header shape of a line after its priority value."""
    return (
        F.when(
            content.startswith("1 "),
            F.when(F.size(F.split(content, " ", 7)) >= 7, F.lit("rfc5424")).otherwise(
                F.lit("rfc5424_short")
            ),
        )
        .when(content.rlike(BSD), F.lit("rfc3164"))
        .when(content.rlike(BRACKET_ISO), F.lit("bracket_iso"))
        .when(content.rlike(PLAIN_ISO), F.lit("iso"))
        .when(content.rlike(VALKEY), F.lit("valkey"))
        .when(content.rlike(APP_PIPE), F.lit("app_pipe"))
        .when(content.rlike(LOGFMT), F.lit("logfmt"))
        .otherwise(F.lit("plain"))
    )


def tag_parts(text: Column) -> Column:
    """``struct(app, message)`` of a message part; ``app`` is null without a tag."""

    def split_tag(t: Column) -> Column:
        def pair(pattern: str) -> Column:
            return F.struct(_part(t, pattern, 1).alias("app"), _part(t, pattern, 2).alias("message"))

        none = F.struct(F.lit(None).cast("string").alias("app"), t.alias("message"))
        return (
            F.when(t.rlike(_TAG_COLON), pair(_TAG_COLON))
            .when(t.rlike(_TAG_PID), pair(_TAG_PID))
            .when(t.rlike(_TAG_BRACKET) & ~_is_level(_part(t, _TAG_BRACKET, 1)), pair(_TAG_BRACKET))
            .when(t.rlike(_TAG_SPACE) & ~_is_level(_part(t, _TAG_SPACE, 1)), pair(_TAG_SPACE))
            .otherwise(none)
        )

    return let(text, split_tag)


def _is_hostname(token: Column) -> Column:
    colon_end = token.endswith(":") & ~token.endswith("::")
    return (
        (token != "") & (token != "-") & ~token.contains("[") & ~token.contains("]")
        & ~_is_level(token) & ~colon_end
    )


def host_parts(rest: Column, bracketed: Column) -> Column:
    """``struct(host, app, message)`` of the text after a header timestamp."""
    null = F.lit(None).cast("string")

    def with_tag(host: Column, text: Column) -> Column:
        return let(
            tag_parts(text),
            lambda p: F.struct(host.alias("host"), p["app"].alias("app"), p["message"].alias("message")),
        )

    def read(t: Column) -> Column:
        words = F.split(t, " ", 2)
        first, after = F.get(words, 0), F.get(words, 1)
        named = F.size(words) == 2
        free = (
            F.when(named & _is_hostname(first), with_tag(first, after))
            .when(named & (first == "-"), with_tag(null, after))
            .otherwise(with_tag(null, t))
        )
        own_host = t.rlike(_HOST_ONLY) & ~_is_level(_part(t, _HOST_ONLY, 1))
        boxed = (
            F.when(
                t.rlike(_HOST_APP),
                F.struct(
                    _part(t, _HOST_APP, 1).alias("host"),
                    _part(t, _HOST_APP, 2).alias("app"),
                    _part(t, _HOST_APP, 3).alias("message"),
                ),
            )
            .when(own_host, with_tag(_part(t, _HOST_ONLY, 1), _part(t, _HOST_ONLY, 2)))
            .otherwise(with_tag(null, t))
        )
        return F.when(bracketed, boxed).otherwise(free)

    return let(rest, read)


def after_structured_data(remainder: Column) -> Column:
    """The message after the structured data field of an RFC 5424 line."""
    run = _part(remainder, SD_RUN, 1)
    return (
        F.when(remainder.startswith("-"), F.ltrim(F.substr(remainder, F.lit(2))))
        .when(run != "", F.ltrim(F.substr(remainder, F.length(run) + 1)))
        .otherwise(remainder)
    )


def month_number(name: Column) -> Column:
    return lookup({m: i for i, m in enumerate(fixed.MONTHS, 1)}, F.lower(name))


def bsd_instant(content: Column, received: Column, tz: str) -> Column:
    """The instant of a BSD header, with the microseconds of its arrival; null when impossible."""
    month = month_number(_part(content, BSD, 1))
    day = _part(content, BSD, 2)
    clock = F.concat_ws(":", *[_part(content, BSD, g) for g in (3, 4, 5)])

    def in_year(year: Column) -> Column:
        date = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
        return utc_instant(F.concat(date, F.lit(" "), clock))

    def finish(wall: Column) -> Column:
        right = let(resolve_naive(wall, received, tz), lambda t: correct_future(t, received))
        micros = F.unix_micros(received) % 1_000_000
        return F.timestamp_micros(F.unix_seconds(right) * 1_000_000 + micros)

    # The date must exist in the year of arrival as well
    valid = month.isNotNull() & (F.length(day) <= 2) & in_year(F.year(received)).isNotNull()
    return F.when(valid, let(in_year(infer_year(month, received)), finish))


def valkey_instant(content: Column, received: Column, tz: str) -> Column:
    month = F.coalesce(month_number(_part(content, VALKEY, 3)), F.lit(1))
    date = F.concat_ws(
        "-", _part(content, VALKEY, 4), F.lpad(month.cast("string"), 2, "0"),
        F.lpad(_part(content, VALKEY, 2), 2, "0"),
    )
    clock = F.replace(_part(content, VALKEY, 5), F.lit(","), F.lit("."))
    return let(
        utc_instant(F.concat(date, F.lit(" "), clock)), lambda t: resolve_naive(t, received, tz)
    )


def app_pipe_instant(content: Column, received: Column, tz: str) -> Column:
    date = F.regexp_replace(_part(content, APP_PIPE, 2), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
    clock = F.replace(_part(content, APP_PIPE, 3), F.lit(","), F.lit("."))
    return let(
        utc_instant(F.concat(date, F.lit(" "), clock)), lambda t: resolve_naive(t, received, tz)
    )


def logfmt_message(text: Column) -> Column:
    """The ``msg=`` value of a logfmt text without its quotes, null without one."""

    def bare(value: Column) -> Column:
        # A value that starts with a quote and has no closing one never ends in that quote
        quoted = (F.length(value) > 1) & (
            (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
        )
        return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).when(value != "", value)

    return F.when(text.contains("msg="), let(_part(text, LOGFMT_MSG, 1), bare))


def logfmt_severity(text: Column) -> Column:
    return severity_of_name(_part(text, LOGFMT_LEVEL, 1))


def parse_syslog(
    lines: DataFrame, received_at: str = "received_at", local_tz: str = "UTC",
    max_chars: int | None = fixed.MAX_TEXT_CHARS,
) -> DataFrame:
    """Lines (``value``, ``source_ip`` and the arrival time) as log rows without id, with the
    sender's ``hostname``, the ``format`` of the header, ``timestamp_read``, and whether the line was
    ``truncated`` to ``max_chars`` characters (None: never).

    Other columns of the input are kept. Nothing moves between tasks, so the same function
    serves a stream.
    """
    received = F.col(received_at)
    whole = F.btrim(F.coalesce("value", F.lit("")), F.lit("\r\n"))
    raw = cap_text(whole, max_chars, fixed.SYSLOG_CUT_MARK)
    pri = F.when(F.col("_raw").rlike(PRI_PATTERN), _part(F.col("_raw"), PRI_PATTERN, 1).cast("int"))
    staged = (
        lines.withColumns({"_raw": raw, "_cut": longer_than(whole, max_chars)})
        .withColumns({"_pri": pri, "_text": F.regexp_replace("_raw", PRI_PATTERN, "")})
        .withColumn("format", syslog_format(F.col("_text")))
    )
    text, fmt = F.col("_text"), F.col("format")
    fields = F.split(F.substr(text, F.lit(3)), " ", 6)
    rest = (
        F.when(fmt == "rfc3164", _part(text, BSD, 6))
        .when(fmt == "bracket_iso", _part(text, BRACKET_ISO, 2))
        .when(fmt == "iso", _part(text, PLAIN_ISO, 2))
        .when(fmt == "app_pipe", _part(text, APP_PIPE, 4))
        .when(fmt == "logfmt", _part(text, LOGFMT, 2))
    )
    staged = staged.withColumns({"_h": F.when(fmt == "rfc5424", fields), "_rest": rest})
    boxed = F.when(
        fmt.isin("rfc3164", "bracket_iso", "iso"), host_parts(F.col("_rest"), fmt == "bracket_iso")
    )
    stamp = (
        F.when(fmt == "rfc5424", settle(iso_struct(F.get("_h", 0)), received, local_tz))
        .when(fmt == "rfc3164", bsd_instant(text, received, local_tz))
        .when(fmt == "bracket_iso", parse_ts(_part(text, BRACKET_ISO, 1), received, local_tz))
        .when(fmt == "iso", parse_ts(_part(text, PLAIN_ISO, 1), received, local_tz))
        .when(fmt == "valkey", valkey_instant(text, received, local_tz))
        .when(fmt == "app_pipe", app_pipe_instant(text, received, local_tz))
        .when(fmt == "logfmt", parse_ts(_part(text, LOGFMT, 1), received, local_tz))
    )
    pipe_level = F.when(
        F.col("_rest").rlike(BRACKET_LEVEL), severity_of_name(_part(F.col("_rest"), BRACKET_LEVEL, 1))
    )
    level = (
        F.when(fmt == "valkey", F.coalesce(lookup(fixed.VALKEY_LEVELS, _part(text, VALKEY, 6)), F.lit(6)))
        .when(fmt == "app_pipe", pipe_level)
        .when(fmt == "logfmt", logfmt_severity(F.col("_rest")))
    )
    staged = staged.withColumns({"_b": boxed, "_ts": stamp, "_level": level})
    dash_free = lambda c: F.when(c != "-", c)
    host = F.when(fmt == "rfc5424", dash_free(F.get("_h", 1))).otherwise(F.col("_b.host"))
    app = (
        F.when(fmt == "rfc5424", dash_free(F.get("_h", 2)))
        .when(fmt == "app_pipe", _part(text, APP_PIPE, 1))
        .otherwise(F.col("_b.app"))
    )
    message = (
        F.when(fmt == "rfc5424", after_structured_data(F.get("_h", 5)))
        .when(fmt == "rfc5424_short", F.col("_raw"))
        .when(fmt == "valkey", _part(text, VALKEY, 7))
        .when(
            fmt == "app_pipe",
            F.when(F.col("_level").isNotNull(), _part(F.col("_rest"), BRACKET_LEVEL, 2)).otherwise(
                F.col("_rest")
            ),
        )
        .when(fmt == "logfmt", F.coalesce(logfmt_message(F.col("_rest")), F.col("_rest")))
        .when(fmt == "plain", text)
        .otherwise(F.col("_b.message"))
    )
    staged = staged.withColumn("_message", message)
    shown = F.when(fmt == "rfc3164", F.col("_rest")).when(
        fmt.startswith("rfc5424"), F.substr(text, F.lit(3))
    ).otherwise(text)
    stated = F.coalesce("_level", F.col("_pri") % 8, F.lit(6))
    has_level = F.col("_level").isNotNull() | F.col("_pri").isNotNull()
    source = F.when(shown.startswith("time=") | shown.startswith("ts="), shown).otherwise(F.col("_message"))
    made = {
        "timestamp": normalize_ts(F.col("_ts"), received),
        "received_at": received,
        "source_alias": F.col("source_ip"),
        "app_name": F.coalesce(app, F.lit("unknown")),
        "facility": F.coalesce(F.floor(F.col("_pri") / 8), F.lit(1)).cast("int"),
        "severity": content_severity(stated, has_level, source),
        "message": F.col("_message"),
        "raw": F.col("_raw"),
        "hostname": host,
        "timestamp_read": F.col("_ts").isNotNull(),
        "truncated": F.col("_cut"),
    }
    kept = [c for c in lines.columns if c not in (*made, "value", received_at)]
    return staged.select(*kept, *[c.alias(n) for n, c in made.items()], "format")


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows read in full, and rows to look at: a header that is cut short or whose time could
    not be read, and empty lines."""
    doubtful = (
        (F.col("format") == "rfc5424_short")
        | (~F.col("timestamp_read") & ~F.col("format").isin("plain", "rfc5424_short"))
        | (F.col("raw") == "")
    )
    doubtful = F.coalesce(doubtful, F.lit(False))
    return parsed.filter(~doubtful), parsed.filter(doubtful)


def parse_report(parsed: DataFrame) -> DataFrame:
    """Lines per sender and header shape, with those whose time fell back to the arrival."""
    return parsed.groupBy("source_ip", "format").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(~F.col("timestamp_read")).alias("arrival_time_count"),
    )
