"""Maintenance, context, incidents, bundles, retention, reports, the word index and assembly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import functions as L
from ..operators import (
    assemble,
    context,
    incidents,
    maintenance,
    ordered,
    reports,
    retention,
    textindex,
)
from ..operators.filters import LogFilter
from ..sources import containers, logs as stored, syslog
from .registry import query, us
from .tables import AS_OF, CUTOFF

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

WINDOWS = """, days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) AS r(d)),
  clock AS (SELECT *, CASE WHEN start_time LIKE '__:__' THEN CAST(left(start_time, 2) AS INTEGER) ELSE 2 END AS h,
    CASE WHEN start_time LIKE '__:__' THEN CAST(right(start_time, 2) AS INTEGER) ELSE 0 END AS mi FROM schedules WHERE enabled),
  planned AS (SELECT id AS schedule_id, name, day + to_hours(h) + to_minutes(mi) AS window_start,
    day + to_hours(h) + to_minutes(mi + duration_minutes) AS window_end FROM clock, days
    WHERE recurrence = 'daily' OR (recurrence = 'weekly' AND dayofweek(day) = day_of_week % 7)
      OR (recurrence = 'monthly' AND dayofmonth(day) = least(day_of_month, dayofmonth(last_day(day)))))"""


@query("schedules", WINDOWS + """SELECT schedule_id, name, epoch_us(window_start) AS start_us, epoch_us(window_end) AS end_us
  FROM planned WHERE window_end > TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-01-31'""")
def planned_windows(t):
    w = maintenance.expand_schedules(t.schedules(), START, AS_OF)
    return w.select("schedule_id", "name", us("window_start", "start_us"), us("window_end", "end_us"))


BERLIN = WINDOWS.replace("2023-12-25", "2024-01-25").replace("2024-02-05", "2024-11-20").replace(
    "FROM schedules WHERE enabled", "FROM (SELECT * REPLACE (CASE WHEN id = 3 THEN '02:30' ELSE start_time END AS start_time) FROM schedules) WHERE enabled"
).replace("mi + duration_minutes", "mi")


@query("schedules", BERLIN + """, u AS (SELECT schedule_id, epoch_us(timezone('Europe/Berlin', window_start))
      - CASE WHEN window_start >= TIMESTAMP '2024-10-27 02:00:00' AND window_start < TIMESTAMP '2024-10-27 03:00:00' THEN 3600000000 ELSE 0 END AS start_us FROM planned)
  SELECT schedule_id, start_us, start_us + duration_minutes * 60000000::BIGINT AS end_us FROM u JOIN schedules ON id = schedule_id
  WHERE start_us + duration_minutes * 60000000::BIGINT > epoch_us(TIMESTAMP '2024-02-01') AND start_us < epoch_us(TIMESTAMP '2024-11-10')""")
def planned_windows_in_zone(t):
    """Windows on a wall clock with both changes of a year: one start is skipped, one comes twice."""
    moved = t.schedules().withColumn("start_time", F.when(F.col("id") == 3, "02:30").otherwise(F.col("start_time")))
    utc = dt.timezone.utc
    w = maintenance.expand_schedules(moved, dt.datetime(2024, 2, 1, tzinfo=utc), dt.datetime(2024, 11, 10, tzinfo=utc), "Europe/Berlin")
    return w.select("schedule_id", us("window_start", "start_us"), us("window_end", "end_us"))


@query("schedules", WINDOWS.replace("2024-02-05", "2024-04-05") + """SELECT schedule_id, name, min(epoch_us(window_start)) AS start_us FROM planned
  WHERE window_start > TIMESTAMP '2024-01-31' GROUP BY 1, 2""")
def next_window_starts(t):
    return maintenance.next_starts(t.schedules(), AS_OF).select("schedule_id", "name", us("next_start", "start_us"))


@query("sessions schedules", WINDOWS + """, o AS (SELECT 'api_session' AS src, NULL AS nm, expires_at AS until, log_handling = 'drop_errors' AS dr
    FROM sessions WHERE is_active AND expires_at > TIMESTAMP '2024-01-29 23:45:00' UNION ALL
    SELECT 'scheduled', name, window_end, false FROM planned
    WHERE window_start <= TIMESTAMP '2024-01-29 23:45:00' AND window_end > TIMESTAMP '2024-01-29 23:45:00')
  SELECT count(*) > 0 AS active, max(epoch_us(until)) AS until_us,
    CAST(greatest((max(epoch_us(until)) - epoch_us(TIMESTAMP '2024-01-29 23:45:00')) // 1000000, 0) AS BIGINT) AS remaining_seconds,
    CASE WHEN count(*) FILTER (src = 'api_session') > 0 THEN 'api_session' WHEN count(*) > 0 THEN 'scheduled' END AS reason,
    count(*) FILTER (src = 'api_session') AS active_sessions_count,
    CASE WHEN bool_or(dr) THEN 'drop_errors' ELSE 'silence_alerts' END AS log_handling FROM o""")
def maintenance_state(t):
    at = dt.datetime(2024, 1, 29, 23, 45, tzinfo=dt.timezone.utc)
    out = maintenance.maintenance_status(t.sessions(), t.schedules(), at)
    return out.select(
        "active", us("until"), "remaining_seconds", "reason", "active_sessions_count", "log_handling"
    )


SESSION_HITS = """, spans AS (SELECT *, least(expires_at, coalesce(ended_at, expires_at)) AS stop FROM sessions
    WHERE log_handling = 'drop_errors'),
  met AS (SELECT id, session_id, row_number() OVER (PARTITION BY id ORDER BY expires_at DESC, session_id) AS p
    FROM logs JOIN spans ON "timestamp" >= created_at AND "timestamp" < stop AND severity <= 3
      AND (target_app IS NULL OR app_name = 'kernel')
      AND (target_host IS NULL OR (target_host = 'host-?' AND regexp_matches(source_alias, '^host-.$'))
        OR (target_host = '10.0.0.1*' AND (source_ip LIKE '10.0.0.1%' OR source_alias LIKE '10.0.0.1%'))))"""


@query("logs sessions", SESSION_HITS + """SELECT logs.id, session_id FROM logs LEFT JOIN met ON met.id = logs.id AND p = 1""")
def session_drops(t):
    return maintenance.maintenance_drops(t.logs(), t.sessions()).select("id", "session_id")


@query("logs sessions", SESSION_HITS + """SELECT logs.id, session_id FROM logs LEFT JOIN met ON met.id = logs.id AND p = 1""")
def session_drops_joined(t):
    return maintenance.maintenance_drops(t.logs(), t.sessions()).select("id", "session_id")


@query(same_as="session_drops_joined")
def session_drops_compiled(t):
    """Few sessions as conditions on the scan."""
    return maintenance.maintenance_drops(t.logs(), t.sessions(), compiled=10_000).select("id", "session_id")


@query("logs sessions", SESSION_HITS + """, n AS (SELECT session_id, count(*) AS n FROM met WHERE p = 1 GROUP BY 1)
  SELECT session_id, coalesce(n, 0) AS newly_dropped, CAST(dropped_count + coalesce(n, 0) AS BIGINT) AS dropped_count
  FROM sessions LEFT JOIN n USING (session_id)""")
def drop_counts_per_session(t):
    dropped = maintenance.maintenance_drops(t.logs(), t.sessions())
    return maintenance.session_drop_counts(dropped, t.sessions())


@query("incidents sessions schedules", WINDOWS + """, w AS (SELECT window_start AS a, window_end AS b FROM planned
    WHERE window_end > TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-01-31'
    UNION ALL SELECT created_at, least(expires_at, coalesce(ended_at, expires_at)) FROM sessions)
  SELECT id, NOT EXISTS (SELECT 1 FROM w WHERE triggered_at >= a AND triggered_at < b) AS notified FROM incidents""")
def silenced_incidents(t):
    planned = maintenance.expand_schedules(t.schedules(), START, AS_OF).select("window_start", "window_end")
    windows = planned.unionByName(maintenance.window_rows(t.sessions()))
    return maintenance.silence_incidents(t.incidents(), windows).select("id", "notified")


CONTEXT = """, r AS (SELECT *, CASE WHEN source_alias = '' THEN 'ip:' || source_ip ELSE 'alias:' || source_alias END AS host,
    row_number() OVER (PARTITION BY CASE WHEN source_alias = '' THEN 'ip:' || source_ip ELSE 'alias:' || source_alias END{0}
      ORDER BY "timestamp", id) AS p FROM logs),
  t AS (SELECT id AS target_id, host AS h, app_name AS a, p AS tp FROM r WHERE app_name = 'cron')
  SELECT id, target_id, p - tp AS distance FROM r JOIN t ON host = h{1} AND abs(p - tp) <= {2}"""


@query("logs", CONTEXT.format("", "", 5))
def rows_around(t):
    targets = t.logs().filter("app_name = 'cron'").select("id")
    return context.log_context(t.logs(), targets, n=5).select("id", "target_id", "distance")


@query("logs", CONTEXT.format(", app_name", " AND app_name = a", 2))
def rows_around_same_app(t):
    targets = t.logs().filter("app_name = 'cron'").select("id")
    return context.log_context(t.logs(), targets, n=2, same_app=True).select("id", "target_id", "distance")


AROUND = """SELECT i.id AS incident_id, logs.id AS id FROM incidents i JOIN logs
  ON i.host = coalesce(nullif(source_alias, ''), source_ip)
  AND epoch_us("timestamp") BETWEEN epoch_us(triggered_at) - greatest(window_seconds, 60) * 1000000 AND epoch_us(triggered_at) + 60000000"""


@query("logs incidents", AROUND)
def rows_of_incidents(t):
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    return context.incident_logs(inc, t.logs()).select("incident_id", "id")


@query("logs incidents", AROUND + " AND i.app_name = logs.app_name")
def rows_of_incidents_same_app(t):
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    return context.incident_logs(inc, t.logs(), same_app=True).select("incident_id", "id")


@query("incidents audits sessions", """, page AS (SELECT * FROM incidents WHERE rule_id = 3 ORDER BY triggered_at DESC, id DESC LIMIT 40 OFFSET 5)
  SELECT p.id, rule_name, a.response_text AS a_response_text, a.tokens_used AS a_tokens_used, s.log_handling AS m_log_handling,
    epoch_us(s.created_at) AS m_created_us FROM page p LEFT JOIN audits a ON a.id = ai_audit_id
  LEFT JOIN sessions s ON s.session_id = maintenance_session_id""")
def history_page(t):
    out = incidents.incident_history(t.incidents(), t.audits(), t.sessions(), limit=40, offset=5, rule_id=3)
    return out.select(
        "id", "rule_name", "a_response_text", "a_tokens_used", "m_log_handling", us("m_created_at", "m_created_us")
    )


@query("incidents", "SELECT count(*) AS total FROM incidents")
def history_count(t):
    return incidents.history_total(t.incidents())


KIND = """CASE WHEN maintenance_session_id IS NOT NULL THEN 'maintenance' WHEN rule_name = 'Daily Digest' THEN 'digest'
  WHEN rule_id IS NULL AND (rule_name = 'On-Demand Analysis' OR (ai_audit_id IS NOT NULL AND sample_log IS NULL))
  THEN 'on_demand' ELSE 'alert' END"""


@query("incidents", f"SELECT {KIND} AS kind, count(*) AS count FROM incidents GROUP BY 1")
def history_kinds(t):
    return incidents.history_by_kind(t.incidents())


@query("incidents", """, f AS (SELECT * FROM incidents WHERE maintenance_session_id IS NULL
    AND NOT (rule_id IS NULL AND rule_name IN ('Daily Digest', 'On-Demand Analysis')))
  SELECT count(*) FILTER (triggered_at >= TIMESTAMP '2024-01-29 23:45:00') > 0 AS active,
    count(*) FILTER (triggered_at >= TIMESTAMP '2024-01-29 23:45:00') AS recent_firing_count,
    max(epoch_us(triggered_at)) AS last_triggered_at_us, arg_max(rule_name, (triggered_at, id)) AS last_rule_name FROM f""")
def alert_states(t):
    at = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)
    out = incidents.alert_state(t.incidents(), at)
    return out.select("active", "recent_firing_count", us("last_triggered_at"), "last_rule_name")


@query("incidents channels", """SELECT i.id, c.id AS target_channel_id, c.name AS channel_name FROM incidents i
  JOIN channels c ON (i.channel_id IS NULL OR i.channel_id = c.id) AND c.is_enabled""")
def outbox(t):
    out = incidents.notification_outbox(t.incidents(), t.channels())
    return out.select("id", "target_channel_id", "channel_name")


@query("messages", """SELECT audit_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (role = 'user') >= 3 AS limit_reached,
  count(*) AS message_count, CAST(sum(tokens_used) AS BIGINT) AS tokens_used FROM messages GROUP BY 1""")
def thread_figures(t):
    return incidents.thread_turns(t.messages(), limit=3)


BUNDLE = AROUND.replace("SELECT i.id AS incident_id, logs.id AS id", """SELECT i.id AS incident_id, logs.id AS id, "timestamp",
  '[' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '] [' || coalesce(nullif(source_alias, ''), source_ip) || '] ['
  || logs.app_name || '] [' || (['EMERG','ALERT','CRIT','ERROR','WARN','NOTICE','INFO','DEBUG'])[severity + 1] || '] ' || message AS line""")


def _with_secrets(logs: DataFrame) -> DataFrame:
    """Logs in which every fifth message ends in a password."""
    secret = F.when(F.col("id") % 5 == 0, F.concat(F.lit(" password=p"), F.col("id").cast("string"))).otherwise("")
    return logs.withColumn("message", F.concat("message", secret))


REDACTED_BUNDLE = BUNDLE.replace("|| message AS line", "|| message || CASE WHEN logs.id % 5 = 0 THEN ' password=[REDACTED]' ELSE '' END AS line")


@query("logs incidents", f""", l AS ({REDACTED_BUNDLE}), b AS (SELECT incident_id, string_agg(line, chr(10) ORDER BY "timestamp", id) AS bundle,
    count(*) AS line_count FROM l GROUP BY 1)
  SELECT incident_id, bundle, false AS truncated, line_count, CAST(floor(length(bundle) / 3.5) AS BIGINT) + 50 AS size_estimate FROM b""")
def review_bundles(t):
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    return incidents.incident_bundles(context.incident_index(inc, _with_secrets(t.logs())))


CUT = f""", l AS ({BUNDLE}), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY incident_id ORDER BY "timestamp" DESC, id DESC)
    AS upto, sum(length(line) + 1) OVER (PARTITION BY incident_id) AS total FROM l),
  kept AS (SELECT incident_id, id, "timestamp", line, total - 1 > 400 AS truncated FROM s WHERE total - 1 <= 400
    OR (total - 1 > 400 AND upto <= 400 - 51)
    OR (upto = length(line) + 1 AND total - 1 > 400))
  """


@query("logs incidents", CUT + "SELECT incident_id, id, truncated FROM kept")
def newest_in_budget(t):
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    logs = t.logs().withColumn("line", L.prompt_line())
    lines = context.incident_logs(inc, logs, newest=("line", 400)).select("incident_id", "timestamp", "id", "line")
    kept = incidents.newest_within_budget(lines, ["incident_id"], ["timestamp", "id"], max_chars=400)
    return kept.select("incident_id", "id", "truncated")


@query("logs incidents", CUT + """SELECT incident_id, count(*) AS line_count, bool_or(truncated) AS truncated,
  sum(length(line) + 1) - 1 + CASE WHEN bool_or(truncated) THEN 51 ELSE 0 END AS chars FROM kept GROUP BY 1""")
def cut_bundles(t):
    """Bundles whose budget cuts some of them, from intervals."""
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    out = incidents.incident_bundles(context.incident_index(inc, t.logs()), max_chars=400, redacted=False)
    return out.select("incident_id", "line_count", "truncated", F.length("bundle").cast("long").alias("chars"))


@query("logs incidents", """, i AS (SELECT id AS incident_id, host, epoch_us(triggered_at) - greatest(window_seconds, 60) * 1000000 AS a,
    epoch_us(triggered_at) + 60000001 AS b FROM incidents),
  c AS (SELECT host, t, row_number() OVER (PARTITION BY host ORDER BY t) AS n FROM (SELECT host, a AS t FROM i UNION SELECT host, b FROM i))
  SELECT incident_id, i.host, c.n AS first, d.n - 1 AS last, (SELECT count(*) FROM logs WHERE coalesce(nullif(source_alias, ''), source_ip) = i.host
      AND epoch_us("timestamp") >= a AND epoch_us("timestamp") < b) AS log_count
  FROM i JOIN c ON c.host = i.host AND c.t = a JOIN c d ON d.host = i.host AND d.t = b""")
def runs_of_incidents(t):
    """Each incident as a run of intervals, and its rows counted by interval."""
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    index = context.incident_index(inc, t.logs())
    held = index.rows.groupBy("place", "interval").agg(F.count("*").alias("n"))
    sums = index.pairs(held).groupBy("incident_id").agg(F.sum("n").alias("n"))
    log_count = F.coalesce("n", F.lit(0)).alias("log_count")
    return index.runs.join(sums, "incident_id", "left").select("incident_id", F.col("place.host").alias("host"), "first", "last", log_count)


@query("logs incidents aliases", f""", l AS ({AROUND.replace("logs.id AS id", 'source_alias, source_ip, logs.app_name, "timestamp"')}),
  n AS (SELECT DISTINCT incident_id, coalesce(nullif(alias, ''), ip) AS name, trim(notes) AS note FROM l JOIN aliases a
    ON (l.source_ip = a.ip OR l.source_alias = a.alias) WHERE trim(notes) <> ''),
  m AS (SELECT incident_id, string_agg('- [' || name || ']: ' || note, chr(10) ORDER BY name, note) AS notes
    FROM (SELECT incident_id, name, max(note) AS note FROM n GROUP BY 1, 2) GROUP BY 1)
  SELECT l.incident_id, coalesce(nullif(string_agg(DISTINCT nullif(source_alias, ''), ', ' ORDER BY nullif(source_alias, '')), ''),
      arg_min(source_ip, "timestamp")) AS hosts, string_agg(DISTINCT app_name, ', ' ORDER BY app_name) AS apps, count(*) AS log_count,
    'UTC+01:00' AS offsets, any_value(notes) AS notes FROM l LEFT JOIN m ON m.incident_id = l.incident_id GROUP BY 1""")
def bundle_headers(t):
    inc = t.incidents().withColumnRenamed("id", "incident_id")
    return incidents.incident_headers(context.incident_index(inc, t.logs()), "Europe/Berlin", t.aliases())


@query("logs", """SELECT id FROM logs WHERE NOT (severity <= 2 AND app_name = 'kernel')""")
def kept_after_delete(t):
    kept, _ = retention.delete_logs(t.logs(), LogFilter(apps=["kernel"], severity_max=2))
    return kept.select("id")


@query("logs", """SELECT count(*) AS deleted FROM logs WHERE severity <= 2 AND app_name = 'kernel'""")
def delete_preview(t):
    _, gone = retention.delete_logs(t.logs(), LogFilter(apps=["kernel"], severity_max=2))
    return gone


@query("logs", """SELECT id FROM logs ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON id = o_orderkey""")
def kept_after_id_delete(t):
    ids = t.read("orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return retention.delete_by_ids(t.logs(), ids).select("id")


@query("logs", "SELECT id FROM logs WHERE id > 4321")
def kept_after_full_delete(t):
    return retention.delete_all(t.logs(), 4321).select("id")


@query("logs", """SELECT id FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-16'""")
def pruned_logs(t):
    return retention.prune_logs(t.logs(), 15, AS_OF).select("id")


EXPIRY = """, x AS (SELECT i.*, CASE WHEN s.session_id IS NULL THEN triggered_at < TIMESTAMP '2024-01-16'
    ELSE coalesce(NOT is_active AND ended_at < TIMESTAMP '2024-01-16', false) END AS expired
    FROM incidents i LEFT JOIN sessions s ON s.session_id = maintenance_session_id)"""
REMOVED = """, gone AS (SELECT id FROM audits WHERE (id IN (SELECT ai_audit_id FROM x WHERE expired AND ai_audit_id IS NOT NULL)
    AND id NOT IN (SELECT ai_audit_id FROM x WHERE NOT expired AND ai_audit_id IS NOT NULL))
    OR ("timestamp" < TIMESTAMP '2024-01-16' AND id NOT IN (SELECT ai_audit_id FROM x WHERE ai_audit_id IS NOT NULL)))"""


@query("incidents sessions", EXPIRY + "SELECT id FROM x WHERE NOT expired")
def pruned_history(t):
    return retention.prune_history(t.incidents(), t.sessions(), CUTOFF).select("id")


@query("sessions", "SELECT session_id FROM sessions WHERE is_active OR ended_at IS NULL OR ended_at >= TIMESTAMP '2024-01-16'")
def pruned_sessions(t):
    return retention.prune_sessions(t.sessions(), CUTOFF).select("session_id")


@query("audits incidents", """SELECT id FROM audits WHERE "timestamp" < TIMESTAMP '2024-01-16'
  AND id NOT IN (SELECT ai_audit_id FROM incidents WHERE ai_audit_id IS NOT NULL)""")
def audits_without_incident(t):
    return retention.orphan_audits(t.audits(), t.incidents(), CUTOFF).select("id")


@query("audits incidents sessions", EXPIRY + """SELECT id FROM audits WHERE id IN (SELECT ai_audit_id FROM x WHERE expired AND ai_audit_id IS NOT NULL)
  AND id NOT IN (SELECT ai_audit_id FROM x WHERE NOT expired AND ai_audit_id IS NOT NULL)""")
def audits_of_expired(t):
    return retention.linked_audits(t.audits(), t.incidents(), t.sessions(), CUTOFF).select("id")


@query("audits messages incidents sessions", EXPIRY + REMOVED + """SELECT 'audit' AS kind, id, NULL AS turn FROM audits WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'message', audit_id, turn FROM messages WHERE audit_id NOT IN (SELECT id FROM gone)""")
def pruned_audits(t):
    kept, threads = retention.prune_audits(t.audits(), t.messages(), t.incidents(), t.sessions(), CUTOFF)
    none = F.lit(None).cast("long").alias("turn")
    return kept.select(F.lit("audit").alias("kind"), "id", none).unionByName(
        threads.select(F.lit("message").alias("kind"), F.col("audit_id").alias("id"), "turn")
    )


@query("metrics", "SELECT epoch_us(recorded_at) AS recorded_at_us FROM metrics WHERE recorded_at >= TIMESTAMP '2024-01-10'")
def pruned_metrics(t):
    at = dt.datetime(2024, 2, 9, tzinfo=dt.timezone.utc)
    return retention.prune_metrics(t.metrics(), at).select(us("recorded_at"))


@query("logs incidents sessions audits metrics", EXPIRY + REMOVED + f""", h AS (SELECT {KIND} AS kind, count(*) AS n FROM x WHERE expired GROUP BY 1),
  c AS (SELECT (SELECT count(*) FROM logs WHERE "timestamp" < TIMESTAMP '2024-01-16') AS logs,
    coalesce((SELECT n FROM h WHERE kind = 'alert'), 0) AS history_alert, coalesce((SELECT n FROM h WHERE kind = 'on_demand'), 0) AS history_on_demand,
    coalesce((SELECT n FROM h WHERE kind = 'digest'), 0) AS history_digest, coalesce((SELECT n FROM h WHERE kind = 'maintenance'), 0) AS history_maintenance,
    (SELECT count(*) FROM metrics WHERE recorded_at < TIMESTAMP '2024-01-01') AS metrics, (SELECT count(*) FROM gone) AS ai_audit,
    CAST((SELECT coalesce(sum(n), 0) FROM h) AS BIGINT) AS history_total)
  SELECT *, logs + history_total + metrics + ai_audit AS total FROM c""")
def prune_counts(t):
    return retention.prune_preview(
        t.logs(), t.incidents(), t.sessions(), t.audits(), t.metrics(), 15, AS_OF
    )


SINCE = """ "timestamp" >= TIMESTAMP '2024-01-30' """
ENTITY = "CASE WHEN lower(source_ip) = 'docker' OR lower(source_alias) = 'docker' THEN app_name ELSE coalesce(nullif(source_alias, ''), source_ip, 'unknown') END"
GROUPED = f"""{ENTITY} AS entity, count(*) AS error_count, count(*) FILTER (severity = 0) AS emerg_count, count(*) FILTER (severity = 1) AS alert_count,
  count(*) FILTER (severity = 2) AS crit_count, count(*) FILTER (severity = 3) AS err_count, min(severity) AS min_severity"""


@query("logs", f"SELECT count(*) AS total_logs, count(*) FILTER (severity <= 3) AS total_errors FROM logs WHERE {SINCE}")
def digest_figures(t):
    return reports.digest_totals(t.logs(), AS_OF)


@query("logs", f"SELECT {GROUPED} FROM logs WHERE severity <= 3 AND {SINCE} GROUP BY 1 ORDER BY min_severity, error_count DESC, entity LIMIT 3")
def digest_worst(t):
    return reports.digest_top_errors(t.logs(), AS_OF)


@query("logs", f"SELECT coalesce(nullif(app_name, ''), 'unknown') AS service, count(*) AS log_count FROM logs WHERE {SINCE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def digest_services(t):
    return reports.digest_top_services(t.logs(), AS_OF)


@query("metrics", """, d AS (SELECT 2000000 - coalesce(arg_min(db_size_bytes, recorded_at) FILTER (recorded_at >= TIMESTAMP '2024-01-30'),
    arg_max(db_size_bytes, recorded_at)) AS delta_bytes FROM metrics)
  SELECT CAST(delta_bytes AS BIGINT) AS delta_bytes, CASE WHEN delta_bytes > 0 THEN '+' || CASE WHEN delta_bytes >= 1048576 THEN
    printf('%.1f MB', delta_bytes / 1048576.0) ELSE printf('%.1f KB', delta_bytes / 1024.0) END ELSE 'less' END AS delta_text FROM d""")
def storage_growth(t):
    return reports.storage_delta(t.metrics(), 2_000_000, AS_OF)


@query("logs", f""", g AS (SELECT CAST("timestamp" AS DATE) AS day, {GROUPED} FROM logs WHERE severity <= 3 GROUP BY 1, 2),
  e AS (SELECT day, string_agg(entity || ': ' || error_count, '; ' ORDER BY p) AS top_errors FROM (SELECT *, row_number() OVER
    (PARTITION BY day ORDER BY min_severity, error_count DESC, entity) AS p FROM g) WHERE p <= 3 GROUP BY 1),
  v AS (SELECT day, string_agg(app_name || ': ' || n, '; ' ORDER BY p) AS top_services FROM (SELECT *, row_number() OVER
    (PARTITION BY day ORDER BY n DESC, app_name) AS p FROM (SELECT CAST("timestamp" AS DATE) AS day, app_name, count(*) AS n FROM logs GROUP BY 1, 2))
    WHERE p <= 3 GROUP BY 1),
  s AS (SELECT CAST("timestamp" AS DATE) AS day, count(*) AS total_logs, count(*) FILTER (severity <= 3) AS total_errors FROM logs GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, total_logs, total_errors, top_errors, top_services FROM s LEFT JOIN e USING (day) LEFT JOIN v USING (day)""")
def digests_per_day(t):
    return reports.daily_digest(t.logs()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _counted(n: str, one: str, many: str) -> str:
    return f"format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {many}' END"


ERROR_PARTS = ", ".join(
    f"CASE WHEN {c}_count > 0 THEN {_counted(c + '_count', one, many)} END"
    for c, one, many in (("emerg", "emerg", "emergs"), ("alert", "alert", "alerts"), ("crit", "crit", "crits"), ("err", "error", "errors"))
)


@query("logs metrics", f""", g AS (SELECT {GROUPED} FROM logs WHERE severity <= 3 AND {SINCE} GROUP BY 1 ORDER BY min_severity, error_count DESC, entity LIMIT 3),
  e AS (SELECT string_agg('- **' || entity || '**: ' || CASE WHEN emerg_count + alert_count + crit_count > 0
      THEN {_counted("error_count", "event", "events")} || ' (' || concat_ws(', ', {ERROR_PARTS}) || ')'
      ELSE {_counted("error_count", "error", "errors")} END, chr(10) ORDER BY min_severity, error_count DESC, entity) AS x FROM g),
  v AS (SELECT app_name AS service, count(*) AS n FROM logs WHERE {SINCE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
  s AS (SELECT string_agg('- **' || service || '**: ' || {_counted("n", "log", "logs")}, chr(10) ORDER BY n DESC, service) AS x FROM v),
  d AS (SELECT 2000000 - coalesce(arg_min(db_size_bytes, recorded_at) FILTER (recorded_at >= TIMESTAMP '2024-01-30'), arg_max(db_size_bytes, recorded_at)) AS n FROM metrics)
  SELECT concat_ws(chr(10), '### 24-Hour Analytical Rollup', '- **Total Logs Ingested:** ' || (SELECT format('{{:,}}', count(*)) FROM logs WHERE {SINCE}),
    '- **System Storage Delta:** ' || (SELECT '+' || CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f KB', n / 1024.0) END FROM d),
    '', '### Top Apps / Hosts with Errors or Above', (SELECT x FROM e), '', '### Top Logging Services', (SELECT x FROM s)) AS body""")
def digest_body(t):
    return reports.digest_text(t.logs(), t.metrics(), 2_000_000, AS_OF)


@query("metrics", """SELECT epoch_us(recorded_at) AS recorded_at_us, total_logs_count,
  round((disk_total_bytes - disk_free_bytes) / disk_total_bytes * 100, 1) AS disk_used_percent FROM metrics WHERE recorded_at >= TIMESTAMP '2024-01-01'""")
def storage_samples(t):
    out = reports.storage_history(t.metrics(), AS_OF)
    return out.select(us("recorded_at"), "total_logs_count", "disk_used_percent")


@query("logs incidents sessions schedules metrics", WINDOWS + """, x AS (SELECT * FROM logs WHERE severity <= 4 AND "timestamp" >= TIMESTAMP '2024-01-30'),
  a AS (SELECT app_name AS name, count(*) AS n FROM x WHERE severity <= 3 AND app_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
  h AS (SELECT coalesce(nullif(source_alias, ''), source_ip) AS name, count(*) AS n FROM x WHERE severity <= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
  f AS (SELECT * FROM incidents WHERE maintenance_session_id IS NULL AND NOT (rule_id IS NULL AND rule_name IN ('Daily Digest', 'On-Demand Analysis'))),
  o AS (SELECT true AS own, expires_at AS until, log_handling = 'drop_errors' AS dr FROM sessions WHERE is_active AND expires_at > TIMESTAMP '2024-01-31'
    UNION ALL SELECT false, window_end, false FROM planned WHERE window_start <= TIMESTAMP '2024-01-31' AND window_end > TIMESTAMP '2024-01-31'),
  m AS (SELECT max(epoch_us(until)) AS until_us, count(*) AS n, count(*) FILTER (own) AS own, bool_or(dr) AS dr FROM o)
  SELECT count(*) FILTER (severity <= 3) AS error_count_24h, count(*) FILTER (severity <= 3 AND "timestamp" >= TIMESTAMP '2024-01-30 23:00:00') AS error_count_1h,
    count(*) FILTER (severity = 0) AS emergency_24h, count(*) FILTER (severity = 1) AS alert_24h, count(*) FILTER (severity = 2) AS critical_24h,
    count(*) FILTER (severity = 3) AS error_24h, count(*) FILTER (severity = 4) AS warning_24h,
    (SELECT string_agg(name, ', ' ORDER BY n DESC, name) FROM a) AS top_error_apps, (SELECT string_agg(name, ', ' ORDER BY n DESC, name) FROM h) AS top_error_hosts,
    (SELECT round(count(*) / 5.0, 2) FROM logs WHERE received_at > TIMESTAMP '2024-01-30 23:59:55' AND received_at <= TIMESTAMP '2024-01-31') AS ingest_rate,
    (SELECT arg_max(db_size_bytes, recorded_at) FROM metrics) AS db_size_bytes, (SELECT arg_max(total_logs_count, recorded_at) FROM metrics) AS total_logs_count,
    (SELECT count(*) FILTER (triggered_at >= TIMESTAMP '2024-01-30 23:45:00') > 0 FROM f) AS alert_active,
    (SELECT count(*) FILTER (triggered_at >= TIMESTAMP '2024-01-30 23:45:00') FROM f) AS recent_firing_count,
    (SELECT max(epoch_us(triggered_at)) FROM f) AS last_triggered_at, (SELECT arg_max(rule_name, (triggered_at, id)) FROM f) AS last_rule_name,
    (SELECT n > 0 FROM m) AS maintenance_active, (SELECT until_us FROM m) AS maintenance_until,
    (SELECT CAST(coalesce(greatest((until_us - epoch_us(TIMESTAMP '2024-01-31')) // 1000000, 0), 0) AS BIGINT) FROM m) AS remaining_seconds,
    (SELECT own FROM m) AS active_sessions_count, (SELECT CASE WHEN dr THEN 'drop_errors' ELSE 'silence_alerts' END FROM m) AS log_handling FROM x""")
def system_report(t):
    out = reports.system_metrics(t.logs(), t.incidents(), t.sessions(), t.schedules(), t.metrics(), AS_OF)
    return out.withColumns({c: F.unix_micros(c) for c in ("last_triggered_at", "maintenance_until")})


POSTINGS = """, p AS (SELECT id AS log_id, field, i - 1 AS pos, w[i] AS token FROM (SELECT id, 'app_name' AS field, regexp_extract_all(lower(app_name), '[a-z0-9]+') AS w FROM logs
    UNION ALL SELECT id, 'source_alias', regexp_extract_all(lower(source_alias), '[a-z0-9]+') FROM logs
    UNION ALL SELECT id, 'message', regexp_extract_all(lower(message), '[a-z0-9]+') FROM logs), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i))"""


@query("logs", POSTINGS + "SELECT field, token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM p GROUP BY 1, 2")
def word_index(t):
    p = textindex.build_postings(t.logs())
    return p.groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))


@query("logs", POSTINGS + "SELECT DISTINCT log_id FROM p WHERE token LIKE 'purch%'")
def index_prefix(t):
    return textindex.lookup(textindex.build_postings(t.logs()), "purch")


@query("logs", """SELECT id, message FROM logs WHERE regexp_matches(message, 'user 14 from ')""")
def index_phrase(t):
    ids = textindex.lookup_phrase(textindex.build_postings(t.logs()), "user 14 from")
    return textindex.logs_of(t.logs(), ids).select("id", "message")


@query("logs", POSTINGS + """SELECT log_id, count(*) AS n FROM p WHERE log_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def index_after_delete(t):
    ids = t.read("orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    left = textindex.drop_postings(textindex.build_postings(t.logs()), ids)
    return left.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))


@query("logs", """SELECT id, app_name, row_number() OVER (ORDER BY received_at, id) + 500 AS new_id FROM logs""")
def assigned_ids(t):
    rows = t.logs().withColumnRenamed("id", "seq")
    return stored.assign_ids(rows, 500).select(F.col("seq").alias("id"), "app_name", F.col("id").alias("new_id"))


@query("logs", """SELECT id, row_number() OVER (PARTITION BY source_ip ORDER BY "timestamp", id) AS place,
    sum(severity) OVER (PARTITION BY source_ip ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM logs""")
def places_and_sums(t):
    placed = ordered.ordinal(t.logs(), ["source_ip"], ["timestamp", "id"], chunk_seconds=3600, name="place")
    summed = ordered.running(
        placed, ["source_ip"], ["timestamp", "id"], {"total": ("sum", F.col("severity"))}, chunk_seconds=3600
    )
    return summed.select("id", "place", "total")


# Lines of documents as streams; the statement covers streams without a traceback.
LINES = r""", l AS (SELECT doc_id, seq, message, regexp_matches(message, '^[ \t]') OR regexp_matches(lower(trim(message, E' \t\n\r\x0b\x0c')),
      '^(caused by:|traceback|goroutine |stack backtrace:)') OR starts_with(message, 'at ') OR starts_with(message, '...')
      OR regexp_matches(trim(message, E' \t\n\r\x0b\x0c'), '^(?:[a-zA-Z_]\w*\.)*[a-zA-Z_]\w*(?:Error|Exception|Warning|Interrupt|Exit|Fault|Notice|Iteration)(?::\s*.*)?$')
      AS cont, trim(message, E' \t\n\r\x0b\x0c') = '' AS blank FROM doc_lines),
  e AS (SELECT *, sum(CASE WHEN NOT cont OR seq = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS entry FROM l),
  k AS (SELECT * FROM e WHERE cont OR NOT blank)"""


@query("doc_lines", LINES + """SELECT CAST(doc_id AS VARCHAR) AS stream_key, min(seq) AS seq, string_agg(message, chr(10) ORDER BY seq) AS message,
    CAST(min(seq % 8) AS INTEGER) AS severity, CAST(count(*) AS INTEGER) AS line_count FROM k GROUP BY doc_id, entry
    HAVING trim(string_agg(message, chr(10) ORDER BY seq), E' \\t\\n\\r\\x0b\\x0c') <> ''""")
def assembled_entries(t):
    limits = assemble.Limits(gap=None, seconds=1e9)
    out = assemble.assemble_multiline(t.doc_streams(), limits)
    return out.select("stream_key", "seq", "message", "severity", "line_count")


# Entries of ``paused_streams``: a line that starts, or one after a pause, opens a block; a block is cut
# after as many lines as a limit allows.
ENTRIES = """, l AS (SELECT doc_id, seq, seq % 13 IN (1, 5) AS opens, CASE WHEN seq % 13 IN (1, 5) THEN 'line ' ELSE '  at ' END || message AS message,
    seq * 40 + (seq // 9) * 400 AS ms FROM doc_lines),
  g AS (SELECT *, opens OR coalesce(ms - lag(ms) OVER (PARTITION BY doc_id ORDER BY seq) > 150, true) AS starts FROM l),
  b AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS block FROM g),
  i AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, block ORDER BY seq) - 1) // {} AS part FROM b)
  SELECT CAST(doc_id AS VARCHAR) AS stream_key, min(seq) AS seq, string_agg(message, chr(10) ORDER BY seq) AS message,
    CAST(count(*) AS INTEGER) AS line_count FROM i GROUP BY doc_id, block, part"""


@query("doc_lines", ENTRIES.format(4))
def assembled_limited_entries(t):
    """Entries with the default gap and a limit of lines, both reached."""
    out = assemble.assemble_multiline(t.paused_streams(), assemble.Limits(lines=4))
    return out.select("stream_key", "seq", "message", "line_count")


REPLAYS = """, d AS (SELECT *, id AS seq FROM logs UNION ALL SELECT *, id + 50 FROM logs WHERE id % 10 < 3),
  m AS (SELECT *, max("timestamp") OVER (PARTITION BY app_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM d),
  f AS (SELECT *, row_number() OVER (PARTITION BY app_name, "timestamp", message ORDER BY seq) AS p FROM m WHERE newest IS NULL OR "timestamp" >= newest)
  SELECT id, seq FROM f WHERE p = 1"""


def repeated_lines(t):
    """The derived logs as lines, three of ten delivered again later."""
    first = t.logs().withColumn("seq", F.col("id"))
    again = t.logs().filter("id % 10 < 3").withColumn("seq", F.col("id") + 50)
    return first.unionByName(again).withColumn("ts", F.col("timestamp"))


@query("logs", REPLAYS)
def replays_dropped(t):
    return assemble.drop_replays(repeated_lines(t), key="app_name").select("id", "seq")


@query("logs", """SELECT id, epoch_us(CASE id % 3 WHEN 0 THEN "timestamp" WHEN 1 THEN date_trunc('second', "timestamp")
    ELSE received_at END) AS ts_us, CASE id % 3 WHEN 0 THEN app_name WHEN 1 THEN 'web' ELSE 'unknown' END AS app_name, facility,
  CASE id % 3 WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'iso' ELSE 'plain' END AS format,
  CASE WHEN id % 3 = 2 THEN app_name || ': ' || message ELSE message END AS message,
  CASE id % 3 WHEN 0 THEN 'box' || (id % 9) WHEN 1 THEN 'edge' END AS hostname FROM logs""")
def parsed_syslog(t):
    pri = F.concat(F.lit("<"), (F.col("facility") * 8 + F.col("severity")).cast("string"), F.lit(">"))
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    box = F.concat(F.lit("box"), (F.col("id") % 9).cast("string"))
    line = (
        F.when(
            F.col("id") % 3 == 0,
            F.concat(pri, F.lit("1 "), iso, F.lit(" "), box, F.lit(" "), "app_name", F.lit(' 77 - [a@1 x="y\\]z"][b] '), "message"),
        )
        .when(
            F.col("id") % 3 == 1,
            F.concat(pri, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" edge web[12]: "), "message"),
        )
        .otherwise(F.col("raw"))
    )
    lines = t.logs().select("id", "received_at", "source_ip", line.alias("value"))
    rows = syslog.parse_syslog(lines)
    return rows.select("id", us("timestamp", "ts_us"), "app_name", "facility", "format", "message", "hostname")


# One line per header shape in turn; the level of rows without a priority value comes from the text.
@query("logs", r"""SELECT id, CASE id % 9 WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc5424_short' WHEN 2 THEN 'rfc3164' WHEN 3 THEN 'bracket_iso'
    WHEN 4 THEN 'iso' WHEN 5 THEN 'valkey' WHEN 6 THEN 'app_pipe' WHEN 7 THEN 'logfmt' ELSE 'plain' END AS format,
  epoch_us(CASE WHEN id % 9 IN (0, 7) THEN "timestamp" WHEN id % 9 IN (1, 8) THEN received_at ELSE date_trunc('second', "timestamp") END)
    + CASE WHEN id % 9 = 2 THEN epoch_us(received_at) % 1000000 ELSE 0 END AS ts_us,
  CASE id % 9 WHEN 0 THEN 'box' WHEN 2 THEN 'gate' WHEN 3 THEN 'box' WHEN 4 THEN 'edge' END AS hostname,
  CASE id % 9 WHEN 0 THEN app_name WHEN 2 THEN 'cron' WHEN 3 THEN 'web' WHEN 4 THEN 'app' WHEN 6 THEN 'keeper' ELSE 'unknown' END AS app_name,
  CAST(CASE WHEN id % 9 IN (0, 1, 2, 8) THEN least(severity, 6) WHEN id % 9 IN (3, 5, 6) THEN 4 WHEN id % 9 IN (4, 7) THEN 3 END AS INTEGER) AS severity,
  CASE WHEN id % 9 IN (0, 1, 2, 8) THEN facility ELSE 1 END AS facility,
  CASE id % 9 WHEN 1 THEN '<' || (facility * 8 + severity) || '>1 short' WHEN 3 THEN 'level=warn ' || message WHEN 4 THEN 'ERROR: ' || message
    ELSE message END AS message FROM logs""")
def parsed_header_shapes(t):
    shape, ts = F.col("id") % 9, F.col("timestamp")
    pri = F.concat(F.lit("<"), (F.col("facility") * 8 + F.col("severity")).cast("string"), F.lit(">"))
    at = lambda form: F.date_format(ts, form)
    iso = at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = (
        F.when(shape == 0, F.concat(pri, F.lit("1 "), iso, F.lit(" box "), "app_name", F.lit(" 77 - - "), "message"))
        .when(shape == 1, F.concat(pri, F.lit("1 short")))
        .when(shape == 2, F.concat(pri, at("MMM "), F.lpad(at("d"), 2, " "), at(" HH:mm:ss"), F.lit(" gate cron[1]: "), "message"))
        .when(shape == 3, F.concat(F.lit("["), at("yyyy-MM-dd HH:mm:ss"), F.lit("] [box] [web] level=warn "), "message"))
        .when(shape == 4, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC edge app: ERROR: "), "message"))
        .when(shape == 5, F.concat(F.lit("12:M "), at("d MMM yyyy HH:mm:ss"), F.lit(" # "), "message"))
        .when(shape == 6, F.concat(F.lit("[keeper] | "), at("dd/MM/yyyy HH:mm:ss"), F.lit(" [WARN] "), "message"))
        .when(shape == 7, F.concat(F.lit('time="'), iso, F.lit('" level=error msg="'), "message", F.lit('"')))
        .otherwise(F.concat(pri, "message"))
    )
    rows = syslog.parse_syslog(t.logs().select("id", "received_at", "source_ip", line.alias("value")))
    return rows.select("id", "format", us("timestamp", "ts_us"), "hostname", "app_name", "severity", "facility", "message")


# Where a level may stand in a line, one spot after another, and lines that state none.
@query("logs", r"""SELECT id, CAST(CASE id % 8 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 6 END
    AS INTEGER) AS severity FROM logs""")
def detected_severities(t):
    kind = F.col("id") % 8
    line = (
        F.when(kind == 0, F.concat(F.lit("lvl = 'warning' "), "message"))
        .when(kind == 1, F.concat(F.lit('{"level": "debug", "text": "'), "message", F.lit('"}')))
        .when(kind == 2, F.concat(F.lit("[main] [ error ] "), "message"))
        .when(kind == 3, F.concat(F.lit("db FATAL: "), "message"))
        .when(kind == 4, F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" NOTICE "), "message"))
        .when(kind == 5, F.concat(F.lit("Traceback (most recent call last):\n"), "message"))
        .when(kind == 6, F.concat(F.lit("panic: "), "message"))
        .otherwise(F.col("message"))
    )
    return t.logs().select("id", L.detect_severity(line).alias("severity"))


@query("logs", """SELECT source_ip, 'plain' AS format, count(*) AS line_count, count(*) AS arrival_time_count FROM logs GROUP BY 1""")
def syslog_shapes(t):
    lines = t.logs().select("received_at", "source_ip", F.col("raw").alias("value"))
    return syslog.parse_report(syslog.parse_syslog(lines))


@query("logs", """SELECT id, epoch_us("timestamp") AS ts_us, 'web' AS app_name, CAST(CASE WHEN id % 2 = 0 THEN 4 ELSE 6 END AS INTEGER) AS severity,
  message, CASE WHEN id % 2 = 0 THEN 'level=warn msg="' || message || '"' ELSE message END AS raw FROM logs""")
def container_rows(t):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z '")
    body = F.when(
        F.col("id") % 2 == 0, F.concat(F.lit('level=warn msg="'), "message", F.lit('"'))
    ).otherwise(F.col("message"))
    lines = t.logs().select(
        "id", "received_at", F.concat(stamp, body).alias("value"), F.lit("abc").alias("container_id"),
        F.lit("/web").alias("container_name"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"),
    )
    rows = containers.parse_container_lines(lines)
    return rows.select("id", us("timestamp", "ts_us"), "app_name", "severity", "message", "raw")


@query("logs", """SELECT id, CASE WHEN id % 3 = 1 AND received_at - last <= INTERVAL 20 MINUTE THEN coalesce(parent, 'unknown')
    WHEN id % 3 = 1 THEN 'unknown' ELSE app_name END AS app_name FROM (SELECT *,
    lag(received_at) OVER (PARTITION BY source_ip ORDER BY received_at, id) AS last,
    last_value(CASE WHEN id % 3 <> 1 THEN app_name END IGNORE NULLS) OVER (PARTITION BY source_ip ORDER BY received_at, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM logs)""")
def orphans_attached_in_time(t):
    """The same with a gap that many orphans miss."""
    return assemble.attach_orphan_lines(_orphans(t), gap=1200.0, chunk_seconds=3600).select("id", "app_name")


def _orphans(t):
    lost = F.col("id") % 3 == 1
    return t.logs().withColumns(
        {
            "seq": F.col("id"),
            "app_name": F.when(lost, "unknown").otherwise(F.col("app_name")),
            "message": F.when(lost, F.concat(F.lit("  at "), "message")).otherwise(F.col("message")),
        }
    )


@query("logs", """SELECT id, CASE WHEN id % 3 = 1 THEN coalesce(parent, 'unknown') ELSE app_name END AS app_name FROM (SELECT *,
    last_value(CASE WHEN id % 3 <> 1 THEN app_name END IGNORE NULLS) OVER (PARTITION BY source_ip ORDER BY received_at, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM logs)""")
def orphans_attached(t):
    out = assemble.attach_orphan_lines(_orphans(t), gap=1e7, chunk_seconds=3600)
    return out.select("id", "app_name")


@query("logs", """SELECT id, 'kept' AS fate, epoch_us(coalesce(ts, received_at)) AS ts_us, coalesce(sev, 6) AS severity FROM (SELECT *,
    CASE WHEN id % 7 <> 0 THEN "timestamp" END AS ts, CASE WHEN id % 9 <> 0 THEN severity END AS sev FROM logs) WHERE id % 11 <> 0
  UNION ALL SELECT id, 'no arrival time', CASE WHEN id % 7 <> 0 THEN epoch_us("timestamp") END,
    CASE WHEN id % 9 <> 0 THEN severity END FROM logs WHERE id % 11 = 0""")
def salvaged_rows(t):
    damaged = t.logs().withColumns(
        {
            "received_at": F.when(F.col("id") % 11 != 0, F.col("received_at")),
            "timestamp": F.when(F.col("id") % 7 != 0, F.col("timestamp")),
            "severity": F.when(F.col("id") % 9 != 0, F.col("severity")),
        }
    )
    good, bad = stored.salvage_rows(damaged)
    shape = lambda df, fate: df.select("id", fate.alias("fate"), us("timestamp", "ts_us"), "severity")
    return shape(good, F.lit("kept")).unionByName(shape(bad, F.col("problem")))


@query("logs", """SELECT id, '[a@1 x="' || id || '"][b y="' || facility || '"]' AS sd, CAST(id AS VARCHAR) AS x, CAST(facility AS VARCHAR) AS y FROM logs""")
def structured_fields(t):
    text = lambda c: F.col(c).cast("string")
    sd = F.concat(F.lit('[a@1 x="'), text("id"), F.lit('"][b y="'), text("facility"), F.lit('"]'))
    raw = F.concat(F.lit("<34>1 - host app 7 - "), sd, F.lit(" "), "message")
    params = L.structured_params(raw)
    return t.logs().select(
        "id", L.structured_data(raw).alias("sd"), params["x"].alias("x"), params["y"].alias("y")
    )
