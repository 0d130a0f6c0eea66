"""Drop rules, alert rules, alert windows and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, rules
from .registry import query, us

# The enabled alert rules as SQL conditions: app, severity, pattern in message or raw.
MATCHES = r""", matches AS (
  SELECT 1 AS rule_id, * FROM logs WHERE app_name = 'kernel' AND severity <= 3
  UNION ALL SELECT 2, * FROM logs WHERE severity <= 3
  UNION ALL SELECT 3, * FROM logs WHERE (app_name LIKE 'ngin%' OR app_name = 'sshd') AND contains(lower(raw), 'user 1')
  UNION ALL SELECT 4, * FROM logs WHERE regexp_matches(message, 'k=\d{2}$')
  UNION ALL SELECT 6, * FROM logs WHERE contains(lower(raw), 'from'))"""


def _windowed(width: int) -> str:
    return f"""count(*) OVER (PARTITION BY rule_id ORDER BY epoch_us("timestamp") // 1000000
      RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"""


DROPPED = r""", dropped AS (SELECT *, CASE
  WHEN regexp_matches(message, '(?i)^purchase user \d+ .*k=1\d$') THEN 3
  WHEN severity >= 5 AND regexp_matches(app_name, '^ngin.$') AND regexp_matches(lower(message), 'user 1.* k=5') THEN 2
  WHEN source_alias = 'docker' OR source_ip = 'docker' THEN CASE WHEN app_name = 'sshd' THEN 1 END END AS early FROM logs)
  , hit AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
    WHEN severity >= 6 AND (source_alias LIKE 'host-1%' OR source_ip = '10.0.0.5') AND contains(lower(message), 'signup') THEN 4
    WHEN severity >= 3 AND source_alias = 'host-3' AND app_name IN ('kernel', 'cron') THEN 6 END AS drop_rule_id FROM dropped)"""


@query("logs", DROPPED + "SELECT id, CAST(drop_rule_id AS BIGINT) AS drop_rule_id FROM hit")
def drop_rule_matches(t):
    return rules.apply_drop_rules(t.logs(), t.drop_rules()).select("id", "drop_rule_id")


@query("logs", DROPPED + "SELECT id, app_name, severity FROM hit WHERE drop_rule_id IS NULL")
def logs_after_drop_rules(t):
    return rules.kept_logs(t.logs(), t.drop_rules()).select("id", "app_name", "severity")


@query("logs", DROPPED + """, r AS (SELECT * FROM (VALUES (1, 'docker views', 10), (2, 'glob', 0), (3, 'regex', 5),
    (4, 'text', 0), (5, 'off', 0), (6, 'exact', 7)) AS r(id, name, old)),
  n AS (SELECT drop_rule_id, count(*) AS n FROM hit GROUP BY 1)
  SELECT CAST(r.id AS BIGINT) AS id, name, coalesce(n, 0) AS newly_dropped,
    CAST(old + coalesce(n, 0) AS BIGINT) AS dropped_count FROM r LEFT JOIN n ON n.drop_rule_id = r.id""")
def drop_counts_per_rule(t):
    return rules.rule_drop_counts(t.logs(), t.drop_rules())


@query("logs", MATCHES + "SELECT id, CAST(rule_id AS BIGINT) AS rule_id FROM matches")
def alert_rule_matches(t):
    return rules.match_alert_rules(t.logs(), t.alert_rules()).select("id", "rule_id")


@query("logs", MATCHES + "SELECT id, CAST(rule_id AS BIGINT) AS rule_id FROM matches")
def alert_rule_matches_indexed(t):
    return rules.match_rules_indexed(t.logs(), t.alert_rules()).select("id", "rule_id")


@query("logs", MATCHES + "SELECT id, CAST(rule_id AS BIGINT) AS rule_id FROM matches WHERE app_name <> 'sshd'")
def alert_matches_with_skip_mark(t):
    marked = t.logs().withColumn("skip_alert_rules", F.col("app_name") == "sshd")
    return rules.match_alert_rules(marked, t.alert_rules()).select("id", "rule_id")


@query("logs", MATCHES + """, r AS (SELECT * FROM (VALUES (1, 'kernel errors'), (2, 'many severe'), (3, 'web or ssh'),
    (4, 'regex'), (6, 'slow storm'), (8, 'broken'), (9, 'path')) AS r(rule_id, name)),
  s AS (SELECT rule_id, count(*) AS n, arg_min(id, (epoch_us("timestamp"), id)) AS first_id,
    arg_min(message, (epoch_us("timestamp"), id)) AS first_message FROM matches GROUP BY 1)
  SELECT CAST(r.rule_id AS BIGINT) AS rule_id, name, coalesce(n, 0) AS match_count, first_id AS sample_log_id,
    first_message AS sample, regexp_extract(first_message, 'from ([0-9.]+)', 1) AS extracted_ip
  FROM r LEFT JOIN s USING (rule_id)""")
def rule_coverage_report(t):
    return rules.rule_coverage(t.logs(), t.alert_rules())


@query("logs", MATCHES + f"""SELECT CAST(rule_id AS BIGINT) AS rule_id, id, window_count FROM (
    SELECT rule_id, id, {_windowed(60)} AS window_count FROM matches WHERE rule_id = 1
    UNION ALL SELECT rule_id, id, {_windowed(21600)} FROM matches WHERE rule_id = 2
    UNION ALL SELECT rule_id, id, {_windowed(43200)} FROM matches WHERE rule_id IN (3, 4))
  JOIN (VALUES (1, 1), (2, 12), (3, 20), (4, 40)) AS s(rid, needed) ON rid = rule_id WHERE window_count >= needed""")
def threshold_windows(t):
    listed = rules.ordered_rules(t.alert_rules())
    matches = rules.match_alert_rules(t.logs(), listed)
    return alerts.threshold_crossings(matches, listed).select("rule_id", "id", "window_count")


@query("logs", MATCHES + f"""SELECT DISTINCT CAST(rule_id AS BIGINT) AS rule_id, sec, n, window_count FROM (
    SELECT rule_id, epoch_us("timestamp") // 1000000 AS sec, {_windowed(2)} AS window_count,
      count(*) OVER (PARTITION BY rule_id, epoch_us("timestamp") // 1000000) AS n FROM matches WHERE rule_id = 6)
  WHERE window_count >= 2""")
def rate_windows(t):
    listed = rules.ordered_rules(t.alert_rules())
    matches = rules.match_alert_rules(t.logs(), listed)
    return alerts.rate_crossings(matches, listed)


# One firing after the other: the next is the first second after the cooldown in which the matches since
# the later of (last firing, second - window) reach the need; of the last firing's own second
# those behind the firing match count.
FIRED = MATCHES + """, rule(rule_id, needed, width, quiet) AS (VALUES (1, 1, 60, 7200), (2, 12, 21600, 3600), (3, 20, 43200, 50000),
    (4, 40, 43200, 600), (6, 2, 2, 900)),
  c AS (SELECT rule_id, epoch_us("timestamp") // 1000000 AS sec, count(*) AS n FROM matches GROUP BY ALL),
  r AS (SELECT c.*, needed, width, quiet, CAST(sum(n) OVER (PARTITION BY rule_id ORDER BY sec) AS BIGINT) AS upto FROM c JOIN rule USING (rule_id)),
  w AS (SELECT a.*, upto - coalesce(low, 0) AS inside FROM r a LEFT JOIN LATERAL
    (SELECT max(b.upto) AS low FROM r b WHERE b.rule_id = a.rule_id AND b.sec < a.sec - a.width) ON true),
  fired(rule_id, sec, place, upto, n) AS (
    SELECT rule_id, sec, greatest(1, needed - (inside - n)), upto, n FROM w WHERE inside >= needed
      QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY sec) = 1
    UNION ALL SELECT rule_id, sec, greatest(1, needed - (held - n)), upto, n FROM (SELECT w.*,
        CASE WHEN f.sec < w.sec - w.width THEN w.inside ELSE w.upto - f.upto + f.n - f.place END AS held,
        row_number() OVER (PARTITION BY w.rule_id ORDER BY w.sec) AS p
      FROM fired f JOIN w ON w.rule_id = f.rule_id AND w.sec > f.sec AND w.sec >= f.sec + w.quiet
      WHERE CASE WHEN f.sec < w.sec - w.width THEN w.inside ELSE w.upto - f.upto + f.n - f.place END >= w.needed) WHERE p = 1)"""


@query("logs", FIRED + """SELECT CAST(rule_id AS BIGINT) AS rule_id, sec AS fire_sec, CAST(0 AS BIGINT) AS k,
  CAST(place AS BIGINT) AS place FROM fired""")
def firing_seconds(t):
    listed = rules.ordered_rules(t.alert_rules())
    matches = rules.match_alert_rules(t.logs(), listed)
    return alerts.firings(alerts.apply_cooldown(alerts.per_second(matches), listed))


CULPRITS = MATCHES + """, d AS (SELECT rule_id, unnest([{'kind': 'app', 'name': app_name},
      {'kind': 'host', 'name': coalesce(nullif(source_alias, ''), source_ip)},
      {'kind': 'message', 'name': trim(left(message, 150))}]) AS x FROM matches),
  g AS (SELECT rule_id, x.kind AS kind, x.name AS name, count(*) AS n FROM d GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY rule_id, kind ORDER BY n DESC, name) AS p,
    CAST(sum(n) OVER (PARTITION BY rule_id, kind) AS BIGINT) AS total FROM g)
  SELECT CAST(rule_id AS BIGINT) AS rule_id, max(total) AS total,
    max(CASE WHEN kind = 'app' THEN name END) AS top_app, max(CASE WHEN kind = 'app' THEN n END) AS top_app_count,
    CAST(round_even(max(CASE WHEN kind = 'app' THEN n END) / max(total) * 100, 0) AS BIGINT) AS top_app_percent,
    max(CASE WHEN kind = 'host' THEN name END) AS top_host, max(CASE WHEN kind = 'host' THEN n END) AS top_host_count,
    CAST(round_even(max(CASE WHEN kind = 'host' THEN n END) / max(total) * 100, 0) AS BIGINT) AS top_host_percent,
    max(CASE WHEN kind = 'message' THEN name END) AS top_message, max(CASE WHEN kind = 'message' THEN n END) AS top_message_count,
    CAST(round_even(max(CASE WHEN kind = 'message' THEN n END) / max(total) * 100, 0) AS BIGINT) AS top_message_percent
  FROM b WHERE p = 1 GROUP BY rule_id"""


@query("logs", CULPRITS)
def rule_culprits(t):
    return alerts.culprits(rules.match_alert_rules(t.logs(), t.alert_rules()), ["rule_id"])


@query("logs", CULPRITS.replace("trim(left(message, 150))", "trim(repeat(message, 9))"))
def rule_culprits_by_whole_message(t):
    """The same over long messages, told apart by the whole text."""
    long = t.logs().withColumn("message", F.repeat("message", F.lit(9)))
    return alerts.culprits(rules.match_alert_rules(t.logs(), t.alert_rules()).join(long.select("id", F.col("message").alias("whole")), "id")
                           .withColumn("message", F.col("whole")), ["rule_id"], key_chars=None)


@query("logs", MATCHES + """SELECT CAST(rule_id AS BIGINT) AS rule_id, id, place FROM (SELECT rule_id, id,
    row_number() OVER (PARTITION BY rule_id ORDER BY "timestamp" DESC, id DESC) AS place FROM matches) WHERE place <= 50""")
def newest_rule_matches(t):
    found = alerts.newest_matches(rules.match_alert_rules(t.logs(), t.alert_rules()))
    return found.select("rule_id", "id", F.col("place").cast("long").alias("place"))


@query("logs", MATCHES + """SELECT CAST(rule_id AS BIGINT) AS rule_id, app_name AS app, arg_max(id, (epoch_us("timestamp"), id)) AS id,
    arg_max(message, (epoch_us("timestamp"), id)) AS message FROM matches GROUP BY 1, 2""")
def newest_match_per_app(t):
    found = alerts.newest_per_app(rules.match_alert_rules(t.logs(), t.alert_rules()))
    return found.select("rule_id", "app", "id", "message")


# With a cooldown longer than the window nothing before a firing can matter to the next one, so a
# statement can follow the firings: the next is the first crossing after the cooldown.
@query("logs", MATCHES + f""", crossed AS (SELECT DISTINCT rule_id, sec, quiet FROM (
    SELECT rule_id, epoch_us("timestamp") // 1000000 AS sec, 7200 AS quiet, {_windowed(60)} AS n, 1 AS needed FROM matches WHERE rule_id = 1
    UNION ALL SELECT rule_id, epoch_us("timestamp") // 1000000, 50000, {_windowed(43200)}, 20 FROM matches WHERE rule_id = 3
    UNION ALL SELECT rule_id, epoch_us("timestamp") // 1000000, 900, {_windowed(2)}, 2 FROM matches WHERE rule_id = 6) WHERE n >= needed),
  follow AS (SELECT a.rule_id, a.sec, min(b.sec) AS next_sec FROM crossed a LEFT JOIN crossed b ON a.rule_id = b.rule_id AND b.sec >= a.sec + a.quiet GROUP BY 1, 2),
  fired AS (SELECT rule_id, min(sec) AS sec FROM crossed GROUP BY 1 UNION ALL
    SELECT f.rule_id, f.next_sec FROM fired JOIN follow f ON f.rule_id = fired.rule_id AND f.sec = fired.sec WHERE f.next_sec IS NOT NULL)
  SELECT CAST(rule_id AS BIGINT) AS rule_id, sec AS fire_sec FROM fired""")
def firings_with_long_cooldown(t):
    listed = [r for r in rules.ordered_rules(t.alert_rules()) if r["cooldown_seconds"] > r["window_seconds"]]
    matches = rules.match_alert_rules(t.logs(), listed)
    return alerts.firings(alerts.apply_cooldown(alerts.per_second(matches), listed)).select("rule_id", "fire_sec")


def _top(name: str, value: str) -> str:
    """The most frequent value behind each firing of the storm rule, with count, percentage and newest match."""
    return f"""{name} AS (SELECT rule_id, fire_sec, {value} AS name, count(*) AS n, arg_max(id, (epoch_us("timestamp"), id)) AS id,
    arg_max(message, (epoch_us("timestamp"), id)) AS message, CAST(round_even(count(*) / any_value(held) * 100, 0) AS BIGINT) AS pct
  FROM h JOIN (SELECT rule_id, fire_sec, held FROM b) USING (rule_id, fire_sec) WHERE rule_id = 6 GROUP BY rule_id, fire_sec, {value} QUALIFY row_number() OVER (PARTITION BY rule_id, fire_sec ORDER BY count(*) DESC, {value}) = 1)"""


BACKTEST = FIRED + f""", numbered AS (SELECT rule_id, id, "timestamp", epoch_us("timestamp") // 1000000 AS sec, app_name,
    coalesce(nullif(source_alias, ''), source_ip) AS host, message,
    row_number() OVER (PARTITION BY rule_id, epoch_us("timestamp") // 1000000 ORDER BY "timestamp", id) AS p FROM matches),
  f AS (SELECT rule_id, sec, place, width, lag(sec) OVER w AS last_sec, lag(place) OVER w AS last_place
    FROM fired JOIN rule USING (rule_id) WINDOW w AS (PARTITION BY rule_id ORDER BY sec)),
  h AS (SELECT f.sec AS fire_sec, numbered.* FROM f JOIN numbered ON numbered.rule_id = f.rule_id AND numbered.sec BETWEEN f.sec - width AND f.sec
    AND (numbered.sec < f.sec OR p <= f.place) AND (last_sec IS NULL OR numbered.sec > last_sec OR (numbered.sec = last_sec AND p > last_place))),
  b AS (SELECT rule_id, fire_sec, count(*) AS held, max(CASE WHEN sec = fire_sec THEN epoch_us("timestamp") END) AS at_us,
    arg_max(id, (epoch_us("timestamp"), id)) AS id, arg_max(message, (epoch_us("timestamp"), id)) AS message,
    arg_max(host, (epoch_us("timestamp"), id)) AS host, arg_max(app_name, (epoch_us("timestamp"), id)) AS app_name FROM h GROUP BY ALL),
  {_top("top_app", "app_name")}, {_top("top_host", "host")}, {_top("top_message", "trim(left(message, 150))")},
  named(rule_id, rule_name, rule_type, channel_id, threshold, seconds) AS (VALUES (1, 'kernel errors', 'pattern', 1, 1, 60),
    (2, 'many severe', 'threshold', NULL, 12, 21600), (3, 'web or ssh', 'threshold', 2, 20, 43200),
    (4, 'regex', 'threshold', NULL, 40, 43200), (6, 'slow storm', 'rate', NULL, 1, 2))
  SELECT CAST(b.rule_id AS BIGINT) AS rule_id, rule_name, rule_type, CAST(channel_id AS BIGINT) AS channel_id, at_us AS triggered_at,
    CASE WHEN rule_type = 'rate' THEN held ELSE least(held, threshold + 1) END AS trigger_count, held AS match_count,
    left(coalesce(a.message, b.message), 1000) AS sample_log, coalesce(a.id, b.id) AS sample_log_id,
    CASE WHEN rule_type = 'rate' THEN 'Log storm detected: ' || held || ' logs in ' || seconds || 's (' || printf('%.1f', round(held / seconds, 1))
      || E' logs/s).\n\n### Primary Culprits\n- Top Service / App: ' || a.name || ' (' || a.n || '/' || held || ', ' || a.pct || E'%)\n- Top Host / Source: '
      || o.name || ' (' || o.n || '/' || held || ', ' || o.pct || E'%)\n- Top Pattern: ' || m.name || ' (x' || m.n || ', ' || m.pct || '%)'
    ELSE 'Alert triggered with ' || least(held, threshold + 1) || ' matching event(s).' END AS incident_summary, seconds AS window_seconds,
    coalesce(o.name, b.host) AS host, coalesce(a.name, b.app_name) AS app_name, CASE WHEN rule_type = 'rate' THEN round(held / seconds, 1) END AS rate, CAST(0 AS BIGINT) AS missing
  FROM b JOIN named USING (rule_id) LEFT JOIN top_app a ON a.rule_id = b.rule_id AND a.fire_sec = b.fire_sec
  LEFT JOIN top_host o ON o.rule_id = b.rule_id AND o.fire_sec = b.fire_sec LEFT JOIN top_message m ON m.rule_id = b.rule_id AND m.fire_sec = b.fire_sec"""


@query("logs", BACKTEST)
def alert_backtest(t):
    out = alerts.fire_alerts(t.logs(), t.alert_rules())
    return out.withColumn("triggered_at", F.unix_micros("triggered_at"))


@query("", r"""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'Log storm detected: ' || n || ' logs in 10s ('
    || printf('%.1f', n / 10.0) || E' logs/s).\n\n### Primary Culprits\n- Top Service / App: ' || event_type || ' (3/' || n
    || ', ' || n || E'%)\n- Top Host / Source: Unknown\n- Top Pattern: user ' || user_id || ' (x2, 9%)'
    ELSE 'Alert triggered with ' || n || ' matching event(s).' END AS incident_summary
  FROM (SELECT *, 1 + event_id % 90 AS n FROM events)""")
def incident_summaries(t):
    n = 1 + F.col("event_id") % 90
    none = F.lit(None)
    e = t.read("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "rate").otherwise("threshold").alias("rule_type"),
        n.alias("trigger_count"), F.lit(10).alias("window_seconds"),
        F.col("event_type").alias("top_app"), F.lit(3).alias("top_app_count"), n.alias("top_app_percent"),
        none.cast("string").alias("top_host"), none.cast("long").alias("top_host_count"),
        none.cast("long").alias("top_host_percent"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("top_message"),
        F.lit(2).alias("top_message_count"), F.lit(9).alias("top_message_percent"),
    )
    return alerts.summarize_incident(e).select("id", "incident_summary")


@query("incidents", """, r AS (SELECT * FROM (VALUES (1, 'kernel errors', 7200), (2, 'many severe', 3600), (3, 'web or ssh', 50000),
    (4, 'regex', 600), (5, 'storm', 7200), (6, 'slow storm', 900), (7, 'off', 60), (8, 'broken', 60), (9, 'path', 60))
    AS r(rule_id, name, quiet)), s AS (SELECT rule_id, count(*) AS n, max(triggered_at) AS last FROM incidents GROUP BY 1)
  SELECT CAST(r.rule_id AS BIGINT) AS rule_id, name, coalesce(n, 0) AS trigger_count, epoch_us(last) AS last_triggered_at_us,
    epoch_us(last) + CAST(quiet AS BIGINT) * 1000000 AS suppress_until_us FROM r LEFT JOIN s USING (rule_id)""")
def rule_timings(t):
    out = alerts.rule_timing(t.incidents(), t.alert_rules())
    return out.select("rule_id", "name", "trigger_count", us("last_triggered_at"), us("suppress_until"))
