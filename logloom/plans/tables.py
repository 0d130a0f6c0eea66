"""The log tables that the registered queries read, derived from the given tables.

The given tables hold no logs. Each frame here is a full-table projection or aggregate of one of
them, and ``SQL`` holds the same definition for the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ALERT_RULES, DROP_RULES
from ..session import bound_broadcasts, ensure_utc

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
CUTOFF = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)

SQL: dict[str, str] = {
    "logs": """
        SELECT event_id AS id, ts AS "timestamp", ts + to_seconds(event_id % 7) AS received_at,
          CASE WHEN user_id % 5 = 1 THEN 'docker' ELSE '10.0.0.' || (user_id % 20) END AS source_ip,
          CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN 'docker'
               ELSE 'host-' || (user_id % 12) END AS source_alias,
          CASE event_type WHEN 'click' THEN 'nginx' WHEN 'view' THEN 'sshd'
               WHEN 'purchase' THEN 'postgres' WHEN 'signup' THEN 'cron' ELSE 'kernel' END AS app_name,
          CAST(event_id % 24 AS INTEGER) AS facility,
          CAST(CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 4 + event_id % 4 END AS INTEGER) AS severity,
          event_type || ' user ' || user_id || ' from 192.168.1.' || (event_id % 250) || ' k='
            || json_extract_string(props, '$.k') AS message,
          '<' || (facility * 8 + severity) || '>' || app_name || ': ' || message AS raw
        FROM events""",
    "aliases": """
        SELECT '10.0.0.' || n_nationkey AS ip, 'site-' || lower(n_name) AS alias,
          CASE WHEN n_regionkey % 2 = 0 THEN 'rack ' || n_regionkey ELSE '' END AS notes
        FROM nation""",
    "containers": "SELECT 'host-' || s_suppkey AS alias FROM supplier WHERE s_suppkey % 50 = 7",
    "incidents": """
        SELECT event_id AS id,
          CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 7 END AS rule_id,
          CASE WHEN user_id % 22 = 0 THEN 'Daily Digest' WHEN user_id % 11 = 0 THEN 'On-Demand Analysis'
               ELSE 'rule ' || (user_id % 7) END AS rule_name,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS channel_id,
          1 + event_id % 9 AS trigger_count,
          CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'sample ' || event_id END AS sample_log,
          event_id AS sample_log_id, 'host-' || (user_id % 12) AS host, 'kernel' AS app_name,
          60 * (1 + event_id % 120) AS window_seconds,
          CASE WHEN event_id % 2 = 0 THEN event_id % 997 END AS ai_audit_id, ts AS triggered_at,
          CASE WHEN user_id % 13 = 0 THEN 'm' || (user_id % 120) END AS maintenance_session_id
        FROM events""",
    "sessions": """
        SELECT 'm' || s_suppkey AS session_id,
          CASE WHEN s_suppkey % 2 = 0 THEN 'drop_errors' ELSE 'silence_alerts' END AS log_handling,
          CASE s_suppkey % 3 WHEN 0 THEN 'ker*' WHEN 1 THEN 'kernel' END AS target_app,
          CASE s_suppkey % 4 WHEN 0 THEN 'host-?' WHEN 2 THEN '10.0.0.1*' END AS target_host,
          TIMESTAMP '2024-01-01' + to_hours(7 * s_suppkey) AS created_at,
          TIMESTAMP '2024-01-01' + to_hours(7 * s_suppkey + 5) AS expires_at,
          s_suppkey > 90 AS is_active,
          CASE WHEN s_suppkey <= 90 THEN TIMESTAMP '2024-01-01' + to_hours(7 * s_suppkey + 2 + s_nationkey % 4)
               END AS ended_at,
          CASE WHEN s_suppkey <= 90 THEN 'done' END AS end_reason, s_suppkey % 5 AS dropped_count
        FROM supplier""",
    "schedules": """
        SELECT r_regionkey AS id, 'plan ' || lower(r_name) AS name, r_regionkey <> 4 AS enabled,
          CASE r_regionkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS recurrence,
          CASE r_regionkey WHEN 1 THEN '23:30' WHEN 2 THEN 'late' ELSE '0' || r_regionkey || ':15' END AS start_time,
          45 * (1 + r_regionkey) AS duration_minutes, r_regionkey + 1 AS day_of_week,
          29 + r_regionkey AS day_of_month
        FROM region""",
    "metrics": """
        SELECT date_trunc('hour', ts) AS recorded_at,
          CAST(1000000 + sum(event_id) % 777777 AS BIGINT) AS db_size_bytes,
          CAST(max(event_id) AS BIGINT) * 1000 AS disk_free_bytes, CAST(20000000000 AS BIGINT) AS disk_total_bytes,
          count(*) AS total_logs_count
        FROM events GROUP BY 1""",
    "audits": """
        SELECT conv_id AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 700 AS BIGINT)) AS "timestamp",
          'host-' || (conv_id % 12) AS source_alias, 'kernel' AS app_name,
          max(CASE WHEN role = 'assistant' THEN text END) AS response_text,
          CAST(sum(length(text)) AS BIGINT) AS tokens_used
        FROM conversations GROUP BY conv_id""",
    "messages": """
        SELECT conv_id AS audit_id, turn, role, text AS content, CAST(length(text) AS BIGINT) AS tokens_used
        FROM conversations""",
    "channels": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS name, r_regionkey % 2 = 0 AS is_enabled
        FROM region""",
    "doc_lines": """
        SELECT doc_id, i AS seq, parts[i] AS message
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
          LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
}


def with_sql(names: str, body: str) -> str:
    """The oracle statement with the definitions of the named tables in front."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH RECURSIVE {ctes} {body.strip()}" if ctes else body.strip()


class Tables:
    """The derived frames of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = bound_broadcasts(ensure_utc(spark)), sf_dir
        self.frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """A given table; its schema is looked up once."""
        if name not in self.frames:
            self.frames[name] = self._open(name)
        return self.frames[name]

    def _open(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(stamps) if stamps else df

    def logs(self) -> DataFrame:
        e = self.read("events")
        uid, eid = F.col("user_id"), F.col("event_id")
        text = lambda c: c.cast("string")
        app = (
            F.when(F.col("event_type") == "click", "nginx")
            .when(F.col("event_type") == "view", "sshd")
            .when(F.col("event_type") == "purchase", "postgres")
            .when(F.col("event_type") == "signup", "cron")
            .otherwise("kernel")
        )
        severity = F.when(F.col("event_type") == "error", eid % 4).otherwise(4 + eid % 4).cast("int")
        message = F.concat(
            "event_type", F.lit(" user "), text(uid), F.lit(" from 192.168.1."), text(eid % 250),
            F.lit(" k="), F.get_json_object("props", "$.k"),
        )
        base = e.select(
            eid.alias("id"),
            F.col("ts").alias("timestamp"),
            F.timestamp_micros(F.unix_micros("ts") + (eid % 7) * 1_000_000).alias("received_at"),
            F.when(uid % 5 == 1, "docker").otherwise(F.concat(F.lit("10.0.0."), text(uid % 20))).alias("source_ip"),
            F.when(uid % 5 == 0, "").when(uid % 5 == 1, "docker")
            .otherwise(F.concat(F.lit("host-"), text(uid % 12))).alias("source_alias"),
            app.alias("app_name"),
            (eid % 24).cast("int").alias("facility"),
            severity.alias("severity"),
            message.alias("message"),
        )
        pri = text(F.col("facility") * 8 + F.col("severity"))
        return base.withColumn(
            "raw", F.concat(F.lit("<"), pri, F.lit(">"), "app_name", F.lit(": "), "message")
        )

    def aliases(self) -> DataFrame:
        return self.read("nation").select(
            F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip"),
            F.concat(F.lit("site-"), F.lower("n_name")).alias("alias"),
            F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("rack "), F.col("n_regionkey").cast("string")))
            .otherwise("").alias("notes"),
        )

    def containers(self) -> DataFrame:
        s = self.read("supplier").filter(F.col("s_suppkey") % 50 == 7)
        return s.select(F.concat(F.lit("host-"), F.col("s_suppkey").cast("string")).alias("alias"))

    def incidents(self) -> DataFrame:
        uid, eid = F.col("user_id"), F.col("event_id")
        no_rule = uid % 11 == 0
        return self.read("events").select(
            eid.alias("id"),
            F.when(~no_rule, uid % 7).alias("rule_id"),
            F.when(uid % 22 == 0, "Daily Digest").when(no_rule, "On-Demand Analysis")
            .otherwise(F.concat(F.lit("rule "), (uid % 7).cast("string"))).alias("rule_name"),
            F.when(eid % 3 != 0, eid % 5).alias("channel_id"),
            (1 + eid % 9).alias("trigger_count"),
            F.when(eid % 10 != 0, F.concat(F.lit("sample "), eid.cast("string"))).alias("sample_log"),
            eid.alias("sample_log_id"),
            F.concat(F.lit("host-"), (uid % 12).cast("string")).alias("host"),
            F.lit("kernel").alias("app_name"),
            (60 * (1 + eid % 120)).alias("window_seconds"),
            F.when(eid % 2 == 0, eid % 997).alias("ai_audit_id"),
            F.col("ts").alias("triggered_at"),
            F.when(uid % 13 == 0, F.concat(F.lit("m"), (uid % 120).cast("string"))).alias("maintenance_session_id"),
        )

    def sessions(self) -> DataFrame:
        k = F.col("s_suppkey")
        hour = lambda h: F.timestamp_seconds(F.lit(1_704_067_200) + h * 3600)
        return self.read("supplier").select(
            F.concat(F.lit("m"), k.cast("string")).alias("session_id"),
            F.when(k % 2 == 0, "drop_errors").otherwise("silence_alerts").alias("log_handling"),
            F.when(k % 3 == 0, "ker*").when(k % 3 == 1, "kernel").alias("target_app"),
            F.when(k % 4 == 0, "host-?").when(k % 4 == 2, "10.0.0.1*").alias("target_host"),
            hour(7 * k).alias("created_at"),
            hour(7 * k + 5).alias("expires_at"),
            (k > 90).alias("is_active"),
            F.when(k <= 90, hour(7 * k + 2 + F.col("s_nationkey") % 4)).alias("ended_at"),
            F.when(k <= 90, "done").alias("end_reason"),
            (k % 5).alias("dropped_count"),
        )

    def schedules(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.read("region").select(
            k.alias("id"),
            F.concat(F.lit("plan "), F.lower("r_name")).alias("name"),
            (k != 4).alias("enabled"),
            F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly").alias("recurrence"),
            F.when(k == 1, "23:30").when(k == 2, "late")
            .otherwise(F.concat(F.lit("0"), k.cast("string"), F.lit(":15"))).alias("start_time"),
            (45 * (1 + k)).alias("duration_minutes"),
            (k + 1).alias("day_of_week"),
            (29 + k).alias("day_of_month"),
        )

    def metrics(self) -> DataFrame:
        return self.read("events").groupBy(F.date_trunc("hour", "ts").alias("recorded_at")).agg(
            (1_000_000 + F.sum("event_id") % 777_777).alias("db_size_bytes"),
            (F.max("event_id") * 1000).alias("disk_free_bytes"),
            F.lit(20_000_000_000).cast("long").alias("disk_total_bytes"),
            F.count(F.lit(1)).alias("total_logs_count"),
        )

    def audits(self) -> DataFrame:
        k = F.col("conv_id")
        return self.read("conversations").groupBy("conv_id").agg(
            F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("response_text"),
            F.sum(F.length("text")).alias("tokens_used"),
        ).select(
            k.alias("id"),
            F.timestamp_seconds(F.lit(1_704_067_200) + (k % 700) * 3600).alias("timestamp"),
            F.concat(F.lit("host-"), (k % 12).cast("string")).alias("source_alias"),
            F.lit("kernel").alias("app_name"),
            "response_text",
            "tokens_used",
        )

    def messages(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("audit_id"), "turn", "role", F.col("text").alias("content"),
            F.length("text").cast("long").alias("tokens_used"),
        )

    def channels(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.read("region").select(
            k.cast("long").alias("id"), F.lower("r_name").alias("name"), (k % 2 == 0).alias("is_enabled")
        )

    def doc_lines(self) -> DataFrame:
        """The lines of the documents as streams: one line per second, document by document."""
        return self.read("documents").select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "message")
        ).select("doc_id", (F.col("_p") + 1).cast("long").alias("seq"), "message")

    def doc_streams(self) -> DataFrame:
        """``doc_lines`` with the columns of ``assemble_multiline``."""
        return self.doc_lines().select(
            F.col("doc_id").cast("string").alias("stream_key"),
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq")).alias("received_at"),
            "seq",
            "message",
            F.col("message").alias("raw"),
            (F.col("seq") % 8).cast("int").alias("severity"),
        )

    def paused_streams(self) -> DataFrame:
        """``doc_streams`` with a line every 40 ms, a longer pause after every ninth, and most lines
        continuing the one before."""
        start = F.when(F.col("seq") % 13 == 1, "line ").when(F.col("seq") % 13 == 5, "line ").otherwise("  at ")
        millis = 1_704_067_200_000 + F.col("seq") * 40 + F.floor(F.col("seq") / 9) * 400
        message = F.concat(start, "message")
        return self.doc_streams().withColumns({"received_at": F.timestamp_millis(millis), "message": message, "raw": message})

    def alert_rules(self) -> DataFrame:
        return self.spark.createDataFrame(ALERT_RULE_ROWS, ALERT_RULES)

    def drop_rules(self) -> DataFrame:
        return self.spark.createDataFrame(DROP_RULE_ROWS, DROP_RULES)


# id, name, type, channel, apps, severity, pattern, count, window, cooldown, enabled, order.
# The logs hold one row per few minutes, so threshold windows last hours.
ALERT_RULE_ROWS = [
    (1, "kernel errors", "pattern", 1, "kernel", 3, "*", 1, 60, 7200, True, 1),
    (2, "many severe", "threshold", None, "", 3, None, 12, 21600, 3600, True, 2),
    (3, "web or ssh", "threshold", 2, "ngin*, sshd", None, "user 1", 20, 43200, 50000, True, 3),
    (4, "regex", "threshold", None, None, 7, r"k=\d{2}$", 40, 43200, 600, True, 4),
    (5, "storm", "rate", 3, "", 6, "", 1, 86400, 7200, False, 5),
    (6, "slow storm", "rate", None, None, 7, "from", 1, 2, 900, True, 6),
    (7, "off", "threshold", None, None, None, "error", 1, 60, 60, False, 7),
    (8, "broken", "pattern", None, None, None, "(unclosed", 1, 60, 60, True, 8),
    (9, "path", "pattern", None, "cron", None, r"C:\Temp", 1, 60, 60, True, 9),
]

# id, name, source, app, message, regex, enabled, severity threshold, dropped, order
DROP_RULE_ROWS = [
    (1, "docker views", "docker", "sshd", None, False, True, None, 10, 3),
    (2, "glob", "", "ngin?", "user 1* k=5", False, True, 5, 0, 2),
    (3, "regex", None, None, r"^purchase user \d+ .*k=1\d$", True, True, None, 5, 1),
    (4, "text", "host-1*, 10.0.0.5", "", "SIGNUP", False, True, 6, 0, 4),
    (5, "off", None, None, None, False, False, None, 0, 0),
    (6, "exact", "host-3", "kernel, cron", "*", False, True, 3, 7, 5),
]
