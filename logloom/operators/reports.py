"""Daily digest, storage figures and the combined system report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bytes_text, fixed
from ..functions.common import blank_to_null
from ..session import stage
from .counts import host_group, hours_before, instant, since
from .incidents import alert_state
from .maintenance import maintenance_status


def digest_totals(logs: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    return since(logs, as_of, hours).agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(F.col("severity") <= 3).alias("total_errors"),
    )


def digest_entity() -> Column:
    """What a digest counts errors under: the app of container rows, else the host."""
    contained = (F.lower("source_ip") == fixed.CONTAINER_SOURCE) | (
        F.lower("source_alias") == fixed.CONTAINER_SOURCE
    )
    return F.when(contained, F.col("app_name")).otherwise(host_group())


SEVERE = {0: "emerg", 1: "alert", 2: "crit", 3: "err"}


def _error_groups(logs: DataFrame, keys: list[Column]) -> DataFrame:
    sev = F.col("severity")
    return (
        logs.filter(sev <= 3)
        .groupBy(*keys, digest_entity().alias("entity"))
        .agg(
            F.count(F.lit(1)).alias("error_count"),
            *[F.count_if(sev == c).alias(f"{n}_count") for c, n in SEVERE.items()],
            F.min("severity").alias("min_severity"),
        )
    )


def _worst_first() -> list[Column]:
    return [F.asc("min_severity"), F.desc("error_count"), F.asc("entity")]


def digest_top_errors(logs: DataFrame, as_of=None, k: int = 3, hours: int = 24) -> DataFrame:
    return _error_groups(since(logs, as_of, hours), []).orderBy(*_worst_first()).limit(k)


def _service() -> Column:
    return F.coalesce(blank_to_null(F.col("app_name")), F.lit("unknown")).alias("service")


def digest_top_services(logs: DataFrame, as_of=None, k: int = 3, hours: int = 24) -> DataFrame:
    return (
        since(logs, as_of, hours)
        .groupBy(_service())
        .agg(F.count(F.lit(1)).alias("log_count"))
        .orderBy(F.desc("log_count"), "service")
        .limit(k)
    )


def storage_delta(metrics: DataFrame, current_bytes: Column | int, as_of=None, hours: int = 24) -> DataFrame:
    """The growth since the first sample in the window, else since the latest sample, else 0."""
    since = hours_before(instant(as_of), hours)
    at = F.col("recorded_at")
    current = current_bytes if isinstance(current_bytes, Column) else F.lit(current_bytes).cast("long")
    first = F.min_by("db_size_bytes", F.when(at >= since, at))
    latest = F.max_by("db_size_bytes", at)
    delta = F.coalesce(current - F.coalesce(first, latest), F.lit(0))
    return metrics.agg(delta.cast("long").alias("delta_bytes")).select(
        "delta_bytes", delta_text(F.col("delta_bytes")).alias("delta_text")
    )


def delta_text(delta: Column) -> Column:
    return (
        F.when(delta > 0, F.concat(F.lit("+"), bytes_text(delta)))
        .when(delta < 0, bytes_text(delta))
        .otherwise(F.lit("0 B"))
    )


def daily_digest(logs: DataFrame, k: int = 3) -> DataFrame:
    """A digest of every day in the logs: totals, worst entities and busiest services.

    One scan counts per day, per day and entity, and per day and service; the ranking keeps ``k`` per day
    before lists are built.
    """
    sev = F.col("severity")
    rows = logs.select(
        F.to_date("timestamp").alias("day"), F.when(sev <= 3, digest_entity()).alias("entity"), _service(), sev.alias("severity")
    )
    sets = [["day"], ["day", "entity"], ["day", "service"]]
    groups = rows.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in ("day", "entity", "service")]).agg(
        F.count(F.lit(1)).alias("log_count"), F.count_if(sev <= 3).alias("error_count"), F.min("severity").alias("min_severity"),
        F.grouping("entity").alias("_no_entity"), F.grouping("service").alias("_no_service"),
    )
    groups = stage(groups, "digest-groups")  # no larger than the names of each day
    totals = groups.filter("_no_entity = 1 AND _no_service = 1").select(
        "day", F.col("log_count").alias("total_logs"), F.col("error_count").alias("total_errors")
    )
    errors = _top_lists(
        groups.filter("_no_entity = 0 AND entity IS NOT NULL"), _worst_first(), k, "top_errors", ["entity", "error_count"]
    )
    services = _top_lists(
        groups.filter("_no_service = 0"), [F.desc("log_count"), F.asc("service")], k, "top_services", ["service", "log_count"]
    )
    return totals.join(errors, "day", "left").join(services, "day", "left")


def _top_lists(groups: DataFrame, order: list[Column], k: int, name: str, cols: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    text = F.concat(F.col(cols[0]), F.lit(": "), F.col(cols[1]).cast("string"))
    return (
        groups.withColumn("_place", place)
        .filter(F.col("_place") <= k)
        .groupBy("day")
        .agg(F.sort_array(F.collect_list(F.struct("_place", text.alias("t")))).alias("_l"))
        .select("day", F.array_join(F.transform("_l", lambda x: x["t"]), "; ").alias(name))
    )


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def digest_text(logs: DataFrame, metrics: DataFrame, current_bytes: int, as_of=None, k: int = 3) -> DataFrame:
    """The 24-hour digest as markdown (one row)."""
    parts = []
    for name, one, many in (
        ("emerg", "emerg", "emergs"), ("alert", "alert", "alerts"), ("crit", "crit", "crits"),
        ("err", "error", "errors"),
    ):
        n = F.col(f"{name}_count")
        parts.append(F.when(n > 0, _counted(n, one, many)))
    worse = (F.col("emerg_count") + F.col("alert_count") + F.col("crit_count")) > 0
    count = F.col("error_count")
    detail = F.when(
        worse,
        F.concat(_counted(count, "event", "events"), F.lit(" ("), F.concat_ws(", ", *parts), F.lit(")")),
    ).otherwise(_counted(count, "error", "errors"))
    error_line = F.concat(F.lit("- **"), F.col("entity"), F.lit("**: "), detail)
    errors = digest_top_errors(logs, as_of, k).select(
        F.struct("min_severity", (-count).alias("c"), "entity", error_line.alias("line")).alias("x")
    )
    services = digest_top_services(logs, as_of, k).select(
        F.struct(
            (-F.col("log_count")).alias("c"), "service",
            F.concat(F.lit("- **"), F.col("service"), F.lit("**: "),
                     _counted(F.col("log_count"), "log", "logs")).alias("line"),
        ).alias("x")
    )

    def listed(df: DataFrame, none: str) -> Column:
        text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n")
        return df.agg(
            F.when(F.count(F.lit(1)) > 0, text).otherwise(F.lit(none)).alias("t")
        ).scalar()

    totals = digest_totals(logs, as_of)
    delta = storage_delta(metrics, current_bytes, as_of).select("delta_text").scalar()
    body = F.concat_ws(
        "\n",
        F.lit(fixed.DIGEST_HEAD),
        F.concat(F.lit(fixed.DIGEST_TOTAL), F.format_number("total_logs", 0)),
        F.concat(F.lit(fixed.DIGEST_DELTA), delta),
        F.lit(""),
        F.lit(fixed.DIGEST_ERRORS),
        listed(errors, fixed.DIGEST_NO_ERRORS),
        F.lit(""),
        F.lit(fixed.DIGEST_SERVICES),
        listed(services, fixed.DIGEST_NO_SERVICES),
    )
    return totals.select(body.alias("body"))


def storage_history(metrics: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Samples of the last days in order, with the used share of the disk."""
    since = hours_before(instant(as_of), 24 * days)
    total, free = F.col("disk_total_bytes"), F.col("disk_free_bytes")
    used = F.when(total > 0, F.round((total - free) / total * 100, 1)).otherwise(F.lit(0.0))
    return (
        metrics.filter(F.col("recorded_at") >= since)
        .withColumn("disk_used_percent", used)
        .orderBy("recorded_at")
    )


def system_metrics(
    logs: DataFrame,
    incidents: DataFrame,
    sessions: DataFrame,
    schedules: DataFrame,
    metrics: DataFrame,
    as_of,
    seconds: int = 5,
) -> DataFrame:
    """One row: error figures, ingest rate, alert state, newest storage sample, maintenance.

    Every part is a single row; they are put side by side by an aggregate over their union. All parts of
    the logs come from one scan of the last day's rows; of a row whose event time is more than a day
    before it arrived, the rate knows nothing.
    """
    now = instant(as_of)
    day_ago = hours_before(now, 24)
    arrived, ts, sev = F.col("received_at"), F.col("timestamp"), F.col("severity")
    recent = ts >= day_ago
    coming = (arrived > hours_before(now, seconds / 3600)) & (arrived <= now)
    rows = since(logs, as_of, 24 + seconds / 3600).filter((recent & (sev <= 4)) | coming)
    error = recent & (sev <= 3)
    rows = rows.select(
        F.when(error & (F.col("app_name") != ""), F.col("app_name")).alias("app"), F.when(error, host_group()).alias("host"),
        F.when(recent, sev).alias("sev"), (ts >= hours_before(now, 1)).alias("last_hour"), coming.alias("coming"),
    )
    sev = F.col("sev")
    per_code = {0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning"}
    groups = rows.groupingSets([[], [F.col("app")], [F.col("host")]], F.col("app"), F.col("host")).agg(
        F.count_if(sev <= 3).alias("error_count_24h"), F.count_if((sev <= 3) & F.col("last_hour")).alias("error_count_1h"),
        *[F.count_if(sev == c).alias(f"{n}_24h") for c, n in per_code.items()],
        F.round(F.count_if(F.col("coming")) / F.lit(float(seconds)), 2).alias("ingest_rate"),
        F.grouping("app").alias("_no_app"), F.grouping("host").alias("_no_host"),
    )
    groups = stage(groups, "system-groups")  # no larger than the names of a day
    stats = groups.filter("_no_app = 1 AND _no_host = 1").drop("app", "host", "_no_app", "_no_host")

    def worst(column: str, out: str) -> DataFrame:
        named = groups.filter(f"_no_{column} = 0 AND {column} IS NOT NULL").select(
            F.col(column).alias("name"), F.col("error_count_24h").alias("count")
        )
        return names(named.orderBy(F.desc("count"), "name").limit(5), out)

    newest = metrics.agg(
        F.max_by("db_size_bytes", "recorded_at").alias("db_size_bytes"),
        F.max_by("total_logs_count", "recorded_at").alias("total_logs_count"),
    )

    def names(df: DataFrame, out: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "name")))
        return df.agg(F.array_join(F.transform(pairs, lambda x: x["name"]), ", ").alias(out))

    parts = [
        stats,
        worst("app", "top_error_apps"),
        worst("host", "top_error_hosts"),
        newest,
        alert_state(incidents, as_of).withColumnRenamed("active", "alert_active"),
        maintenance_status(sessions, schedules, as_of).select(
            F.col("active").alias("maintenance_active"), F.col("until").alias("maintenance_until"),
            "remaining_seconds", "active_sessions_count", "log_handling",
        ),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
