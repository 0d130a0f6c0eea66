"""Counts per severity, app and host, and rolling error figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import blank_to_null
from ..functions.severity import severity_label


def hours_before(as_of: Column, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(hours * 3_600_000_000)))


def instant(as_of) -> Column:
    """A point in time as a Column: a Column, a timestamp literal, or now."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(logs: DataFrame, as_of, hours: float) -> DataFrame:
    """The rows from ``hours`` before ``as_of`` on; earlier days are not opened where rows have a
    ``log_date``."""
    low = hours_before(instant(as_of), hours)
    recent = logs.filter(F.col("timestamp") >= low)
    return recent.filter(F.col("log_date") >= F.to_date(low)) if "log_date" in logs.columns else recent


def host_group() -> Column:
    return F.coalesce(blank_to_null(F.col("source_alias")), F.col("source_ip"), F.lit("unknown"))


def app_group() -> Column:
    return F.coalesce(F.col("app_name"), F.lit("unknown"))


def count_by_severity(logs: DataFrame) -> DataFrame:
    """Rows per severity, worst first."""
    return (
        logs.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("severity", severity_label("severity").alias("label"), "count")
        .orderBy("severity")
    )


def _top_groups(logs: DataFrame, group: Column, limit: int) -> DataFrame:
    """The largest groups with the total over all rows, in one pass over the logs.

    A rollup gives the groups and the total together; only ``limit + 2`` rows leave the top-k,
    so the numbering below runs on those.
    """
    counted = (
        logs.select(group.alias("name"))
        .rollup("name")
        .agg(F.count(F.lit(1)).alias("count"), F.grouping("name").alias("_all"))
        .orderBy(F.desc("_all"), F.desc("count"), F.asc("name"))
        .limit(limit + 2)
    )
    whole = Window.partitionBy()
    place = Window.orderBy(F.desc("_all"), F.desc("count"), F.asc("name"))
    return (
        counted.withColumns(
            {
                "total": F.max(F.when(F.col("_all") == 1, F.col("count"))).over(whole),
                "truncated": F.count(F.lit(1)).over(whole) > limit + 1,
                "_place": F.row_number().over(place),
            }
        )
        .filter((F.col("_all") == 0) & (F.col("_place") <= limit + 1))
        .select("name", "count", "total", "truncated")
    )


def count_by_app(logs: DataFrame, limit: int = 50) -> DataFrame:
    """The apps with most rows, the total over all rows and whether apps were left out."""
    return _top_groups(logs, app_group(), limit)


def count_by_source(logs: DataFrame, limit: int = 50) -> DataFrame:
    """The same per host."""
    return _top_groups(logs, host_group(), limit)


def error_stats(logs: DataFrame, as_of=None) -> DataFrame:
    """Errors of the last 24 hours and the last hour, and rows per severity 0-4, in one pass."""
    now = instant(as_of)
    ts, sev = F.col("timestamp"), F.col("severity")
    recent = since(logs, as_of, 24).filter(sev <= 4)
    per_code = {0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning"}
    return recent.agg(
        F.count_if(sev <= 3).alias("error_count_24h"),
        F.count_if((sev <= 3) & (ts >= hours_before(now, 1))).alias("error_count_1h"),
        *[F.count_if(sev == c).alias(f"{n}_24h") for c, n in per_code.items()],
    )


def _top_errors(logs: DataFrame, group: Column, as_of, k: int) -> DataFrame:
    return (
        since(logs, as_of, 24).filter(F.col("severity") <= 3)
        .groupBy(group.alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "name")
        .limit(k)
    )


def top_error_apps(logs: DataFrame, as_of=None, k: int = 5) -> DataFrame:
    named = logs.filter(F.col("app_name") != "")
    return _top_errors(named, F.col("app_name"), as_of, k)


def top_error_hosts(logs: DataFrame, as_of=None, k: int = 5) -> DataFrame:
    return _top_errors(logs, host_group(), as_of, k)


def volume_counts(logs: DataFrame) -> DataFrame:
    """Rows per host and per app, as (kind, name, count)."""
    kinds = F.array(
        F.struct(F.lit("host").alias("kind"), F.coalesce(
            blank_to_null(F.col("source_alias")), F.col("source_ip")).alias("name")),
        F.struct(F.lit("app").alias("kind"), F.col("app_name").alias("name")),
    )
    return (
        logs.select(F.inline(kinds))
        .filter(F.col("name") != "")
        .groupBy("kind", "name")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def ingest_rate(
    logs: DataFrame, seconds: int = 5, slide: int | None = None, ts: str = "received_at"
) -> DataFrame:
    """Rows per second over windows of arrival time, two decimals. Works on streams as well."""
    w = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    return (
        logs.groupBy(w.alias("window"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "count",
            F.round(F.col("count") / F.lit(float(seconds)), 2).alias("rate"),
        )
    )
