"""Schemas of the tables, and the check applied when one is read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F, types as T

# Stored tables keep the rows of each write under a batch: a stream's batch number, or a number of
# its own, below zero, for any other write.
BATCH = "batch_id"


def own_batch() -> int:
    return -time.time_ns()


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def fields(text: str) -> T.StructType:
    """Nullable fields written as ``name type, name type``; needs no session."""
    pairs = (f.split() for f in text.split(","))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


LOGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("source_ip", T.StringType(), False),
        T.StructField("source_alias", T.StringType(), False),
        T.StructField("app_name", T.StringType(), False),
        T.StructField("facility", T.IntegerType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("raw", T.StringType(), False),
    ]
)

# Values of columns that a source leaves out.
LOG_DEFAULTS = {"source_alias": "", "app_name": "", "facility": 1, "severity": 6}

ALERT_RULES = fields(
    "id long, name string, rule_type string, channel_id long, filter_app string,"
    " filter_severity int, match_pattern string, threshold_count int, window_seconds int,"
    " cooldown_seconds int, is_enabled boolean, display_order int"
)

DROP_RULES = fields(
    "id long, name string, source_pattern string, app_pattern string, message_pattern string,"
    " is_regex boolean, is_enabled boolean, severity_threshold int, dropped_count long,"
    " display_order int"
)

INCIDENTS = fields(
    "rule_id long, rule_name string, rule_type string, channel_id long, triggered_at timestamp,"
    " trigger_count long, sample_log string, sample_log_id long, incident_summary string"
)

HOST_ALIASES = fields("ip string, alias string, notes string")


def conform(
    df: DataFrame, schema: T.StructType, defaults: dict | None = None, fill: bool = True
) -> DataFrame:
    """The frame with exactly the schema's columns and types.

    Missing columns take their default; a missing column without one is an error. ``fill`` also
    replaces nulls by the default; a table written that way is read without, so that filters on
    these columns reach the files.
    """
    defaults = defaults or {}
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in defaults]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    cols = []
    for f in schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(defaults[f.name])
        if fill and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def with_log_date(df: DataFrame) -> DataFrame:
    return df.withColumn("log_date", F.to_date("timestamp"))
