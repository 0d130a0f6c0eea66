"""Maintenance windows: recurring schedules, sessions, dropped errors and silenced incidents."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.common import BLANKS, blank_to_null
from ..functions.patterns import glob_to_regex, is_wild, quote, trimmed
from ..session import join_dimension
from .counts import instant

DAY = 86_400


def _start_clock() -> tuple[Column, Column]:
    """Hour and minute of ``start_time``; 02:00 when it is not a time."""
    parts = F.split(F.coalesce("start_time", F.lit("")), ":")
    hour = F.get(parts, 0).try_cast("int")
    minute = F.coalesce(F.get(parts, 1), F.lit("0")).try_cast("int")
    ok = F.coalesce(hour.between(0, 23) & minute.between(0, 59), F.lit(False))
    return F.when(ok, hour).otherwise(2), F.when(ok, minute).otherwise(0)


def expand_schedules(
    schedules: DataFrame, start: dt.datetime, end: dt.datetime, tz: str = "UTC"
) -> DataFrame:
    """The windows of recurring schedules that overlap [start, end).

    Start times are wall-clock times in ``tz``: one skipped by a clock change moves forward by
    the gap, a repeated one is its first occurrence. A window lasts its minutes of real time.
    """
    minutes = F.greatest(F.coalesce("duration_minutes", F.lit(1)), F.lit(1))
    kind = F.lower(F.coalesce(blank_to_null(F.col("recurrence")), F.lit("weekly")))
    lo, hi = F.lit(start.date()), F.lit(end.date() + dt.timedelta(days=1))
    first = F.date_sub(lo, (F.ceil(minutes / 1440) + 2).cast("int"))
    days = F.sequence(first, hi, F.expr("interval 1 day"))
    want_dow = F.pmod(F.coalesce("day_of_week", F.lit(0)), F.lit(7))
    want_dom = F.greatest(F.coalesce("day_of_month", F.lit(1)), F.lit(1))
    day = F.col("_day")
    on_day = (
        F.when(kind == "daily", F.lit(True))
        .when(kind == "weekly", F.dayofweek(day) - 1 == want_dow)
        .when(kind == "monthly", F.dayofmonth(day) == F.least(want_dom, F.dayofmonth(F.last_day(day))))
        .otherwise(F.lit(False))
    )
    hour, minute = _start_clock()
    clock = F.timestamp_seconds(F.unix_date(day).cast("long") * DAY + hour * 3600 + minute * 60)
    starts = F.to_utc_timestamp(clock, tz)
    ends = F.timestamp_seconds(F.unix_seconds(starts) + minutes * 60)
    windows = (
        schedules.filter("enabled")
        .withColumn("_day", F.explode(days))
        .filter(on_day)
        .withColumns({"window_start": starts, "window_end": ends})
    )
    return windows.filter(
        (F.col("window_end") > instant(start)) & (F.col("window_start") < instant(end))
    ).select(F.col("id").alias("schedule_id"), "name", "window_start", "window_end")


def next_starts(schedules: DataFrame, as_of: dt.datetime, tz: str = "UTC") -> DataFrame:
    """The first start after ``as_of`` of every enabled schedule."""
    ahead = expand_schedules(schedules, as_of, as_of + dt.timedelta(days=64), tz)
    return (
        ahead.filter(F.col("window_start") > instant(as_of))
        .groupBy("schedule_id", "name")
        .agg(F.min("window_start").alias("next_start"))
    )


def session_end() -> Column:
    """The end of a session: when it ended early, else when it expires."""
    return F.least(F.col("expires_at"), F.coalesce("ended_at", F.col("expires_at")))


def maintenance_status(
    sessions: DataFrame,
    schedules: DataFrame,
    as_of: dt.datetime,
    tz: str = "UTC",
) -> DataFrame:
    """One row: whether maintenance is active, until when, why and how logs are handled."""
    now = instant(as_of)
    open_sessions = sessions.filter(
        F.col("is_active") & (F.col("expires_at") > now)
    ).select(
        F.lit("api_session").alias("source"),
        F.lit(None).cast("string").alias("schedule_name"),
        F.col("expires_at").alias("until"),
        (F.col("log_handling") == "drop_errors").alias("drops"),
    )
    planned = expand_schedules(schedules, as_of, as_of + dt.timedelta(seconds=1), tz)
    running = planned.filter(
        (F.col("window_start") <= now) & (now < F.col("window_end"))
    ).select(
        F.lit("scheduled").alias("source"),
        F.col("name").alias("schedule_name"),
        F.col("window_end").alias("until"),
        F.lit(False).alias("drops"),
    )
    is_session = F.col("source") == "api_session"
    all_open = open_sessions.unionByName(running)
    sums = all_open.agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("until").alias("until"),
        F.count_if(is_session).alias("active_sessions_count"),
        F.coalesce(F.max("drops"), F.lit(False)).alias("_drops"),
        F.max_by("schedule_name", F.when(~is_session, F.col("until"))).alias("_schedule"),
    )
    in_session = F.col("active_sessions_count") > 0
    active = F.col("_n") > 0
    left = F.floor((F.unix_micros("until") - F.unix_micros(now)) / 1_000_000)
    return sums.select(
        active.alias("active"),
        "until",
        F.when(active, F.greatest(left, F.lit(0))).otherwise(0).cast("long").alias("remaining_seconds"),
        F.when(in_session, F.lit("api_session")).when(active, F.lit("scheduled")).alias("reason"),
        F.when(~in_session & active, F.col("_schedule")).alias("schedule_name"),
        "active_sessions_count",
        F.when(F.col("_drops"), F.lit("drop_errors"))
        .otherwise(F.lit("silence_alerts"))
        .alias("log_handling"),
    )


def _wildcard_regex(pattern: str) -> str:
    """A single wildcard pattern (commas are plain text) as a regular expression; none as an empty text."""
    low = pattern.lower()
    body = glob_to_regex(low) if is_wild(low) else quote(low)
    return "(?s)^" + body + r"\z" if low else ""


def _listed_sessions(sessions: list[Row]) -> Column:
    """Sessions as one constant, the one that counts first in front. A condition for each would make a plan
    that grows with them, and the driver copies plans."""
    rows = [
        {
            "id": s["session_id"], "start": s["_from"], "end": s["_until"],
            "app": _wildcard_regex(trimmed(s["target_app"])), "host": _wildcard_regex(trimmed(s["target_host"])),
        }
        for s in sessions
    ]
    kinds = "array<struct<id: string, start: bigint, end: bigint, app: string, host: string>>"
    return F.from_json(F.lit(json.dumps(rows)), kinds)


def _wild_sql(c: str, pattern: Column | str) -> Column:
    """Wildcard match against a pattern column, as a LIKE with the same meaning."""
    low = F.lower(F.trim(pattern))
    like = F.regexp_replace(low, r"([\\%_])", r"\\$1")
    like = F.translate(like, "*?", "%_")
    return F.coalesce(F.length(c) > 0, F.lit(False)) & F.coalesce(
        F.call_function("like", F.lower(F.trim(c)), like), F.lit(False)
    )


def maintenance_drops(
    logs: DataFrame, sessions: DataFrame, ts: str = "timestamp", compiled: int = -1
) -> DataFrame:
    """The logs with ``session_id``: the session that drops the row, or null.

    Sessions that drop errors take rows of severity 3 or worse inside their time that match their
    app and host wildcards; of several the one that expires last counts. The sessions of each day are
    one list, the one that counts first in front; a row is joined to the list of its day, and no
    row is grouped or numbered. That is the same for any number of sessions, for stored rows and for
    streams. A caller who knows that there are few may have up to ``compiled`` of them in the condition
    on the scan instead, as one constant that every severe row is compared with.
    """
    droppers = sessions.filter(F.col("log_handling") == "drop_errors").select(
        "session_id", "created_at", "expires_at", "ended_at", "target_app", "target_host"
    )
    severe = F.coalesce(F.col("severity") <= 3, F.lit(False))
    spans_of = droppers.select("*", F.unix_micros("created_at").alias("_from"), F.unix_micros(session_end()).alias("_until"))
    listed = spans_of.limit(compiled + 1).collect() if compiled >= 0 else None
    if listed is not None and len(listed) <= compiled:
        listed.sort(key=lambda s: s["session_id"])
        listed.sort(key=lambda s: s["expires_at"], reverse=True)
        at = F.unix_micros(ts)

        def named(c: str, regex: Column) -> Column:
            return F.coalesce((F.length(c) > 0) & F.regexp_like(F.lower(F.trim(c)), regex), F.lit(False))

        def met_by(s: Column) -> Column:
            host = named("source_alias", s["host"]) | named("source_ip", s["host"])
            in_time = (at >= s["start"]) & (at < s["end"])
            return in_time & ((s["app"] == "") | named("app_name", s["app"])) & ((s["host"] == "") | host)

        found = F.get(F.filter(_listed_sessions(listed), met_by), 0)["id"]
        return logs.withColumn("session_id", F.when(severe, found).cast("string"))
    day = F.floor(F.unix_seconds(F.col(ts)) / DAY)
    target = {c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(BLANKS)) for c in ("target_app", "target_host")}
    spans = droppers.withColumns({**target, "_end": session_end()}).withColumn(
        "_day",
        F.explode(
            F.sequence(
                F.floor(F.unix_seconds("created_at") / DAY), F.floor(F.unix_seconds("_end") / DAY)
            )
        ),
    )
    wanted = F.struct(
        (-F.unix_micros("expires_at")).alias("order"), "session_id", F.col("created_at").alias("start"), F.col("_end").alias("end"),
        F.col("target_app").alias("app"), F.col("target_host").alias("host"),
    )
    per_day = spans.groupBy("_day").agg(F.array_sort(F.collect_list(wanted)).alias("_sessions"))

    def hit(s: Column) -> Column:
        in_time = (F.col(ts) >= s["start"]) & (F.col(ts) < s["end"])
        host = _wild_sql("source_alias", s["host"]) | _wild_sql("source_ip", s["host"])
        return in_time & ((s["app"] == "") | _wild_sql("app_name", s["app"])) & ((s["host"] == "") | host)

    met = join_dimension(logs.withColumn("_day", F.when(severe, day)), per_day, ["_day"])
    chosen = F.get(F.filter("_sessions", hit), 0)["session_id"]
    return met.select(*logs.columns, F.when(severe, chosen).cast("string").alias("session_id"))


def session_drop_counts(dropped: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows dropped per session (of the result of ``maintenance_drops``), added to its counter."""
    counts = (
        dropped.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    )
    fresh = F.coalesce("_n", F.lit(0))
    return sessions.join(counts, "session_id", "left").select(
        "session_id",
        fresh.alias("newly_dropped"),
        (F.coalesce("dropped_count", F.lit(0)) + fresh).cast("long").alias("dropped_count"),
    )


def silence_incidents(
    incidents: DataFrame, windows: DataFrame, bucket_seconds: int = DAY
) -> DataFrame:
    """The incidents with ``notified``: false while any window [window_start, window_end) is open.

    Overlapping windows are merged first, so an incident meets one window at most, in one left join
    on its part of the time (``bucket_seconds``). Incidents of a busy part spread by the salt of
    ``join_dimension``.
    """

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c) / bucket_seconds)

    at = F.col("triggered_at")
    base = incidents.withColumn("_b", bucket(at))
    spans = merged_windows(windows).select(
        "window_start", "window_end",
        F.explode(F.sequence(bucket(F.col("window_start")), bucket(F.col("window_end")))).alias("_b"),
    )
    # All windows of a part of the time in one row; they are disjoint and few
    open_at = spans.groupBy("_b").agg(F.collect_list(F.struct("window_start", "window_end")).alias("_open"))
    inside = F.exists("_open", lambda w: (at >= w["window_start"]) & (at < w["window_end"]))
    met = join_dimension(base, open_at, ["_b"]).withColumn("notified", ~F.coalesce(inside, F.lit(False)))
    return met.select(*incidents.columns, "notified")


def merged_windows(windows: DataFrame) -> DataFrame:
    """Disjoint windows that cover the same time; windows that end before they start are left out."""
    by_start = Window.orderBy("window_start", "window_end")  # configuration: sessions and planned windows
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("window_start") > F.max("window_end").over(before)
    run = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(by_start)
    return (
        windows.select("window_start", "window_end").filter("window_start < window_end")
        .withColumn("_run", run).groupBy("_run")
        .agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"))
        .drop("_run")
    )


def window_rows(sessions: DataFrame) -> DataFrame:
    """Sessions as windows."""
    return sessions.select(
        F.col("created_at").alias("window_start"), session_end().alias("window_end")
    )
