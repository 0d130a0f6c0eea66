"""Container output lines as log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.common import blank_to_null, col, let, lookup, strip
from ..functions.severity import detect_severity, severity_of_name
from ..functions.text import cap_text, clean_text, longer_than
from ..functions.times import container_ts, normalize_ts
from .syslog import APP_PIPE, BRACKET_LEVEL, VALKEY, logfmt_message, logfmt_severity

# Labels that name a container, in order. The first two are the user's own.
COMPOSE_LABELS = ("com.docker.compose.service", "com.docker.swarm.service.name")


def display_name(
    labels: Column | str, name: Column | str, cid: Column | str, own_labels: tuple[str, ...] = ()
) -> Column:
    """The name shown for a container: own label, compose service, swarm service, name, short id.

    ``own_labels`` are the label keys users set to choose a name.
    """
    labels, name, cid = col(labels), col(name), col(cid)

    def clean(c: Column) -> Column:
        return F.regexp_replace(blank_to_null(strip(c)), "^/+", "")

    own = [blank_to_null(F.try_element_at(labels, F.lit(k))) for k in own_labels]
    found = [clean(F.coalesce(*own))] if own else []
    found += [clean(F.try_element_at(labels, F.lit(k))) for k in COMPOSE_LABELS]
    return F.coalesce(
        *found, clean(name), blank_to_null(F.left(cid, F.lit(12))), F.lit("unknown")
    )


def container_message(c: Column | str, default: Column | int = 6) -> Column:
    """``struct(message, severity)`` of a container line: Valkey, app-pipe and logfmt lines give
    their payload and level, others stay with the default severity."""
    default = default if isinstance(default, Column) else F.lit(default)

    def read(t: Column) -> Column:
        pair = lambda m, s: F.struct(m.alias("message"), F.coalesce(s, default).cast("int").alias("severity"))
        rest = F.regexp_extract(t, APP_PIPE, 4)
        level = F.when(rest.rlike(BRACKET_LEVEL), severity_of_name(F.regexp_extract(rest, BRACKET_LEVEL, 1)))
        pipe = F.when(level.isNotNull(), F.regexp_extract(rest, BRACKET_LEVEL, 2)).otherwise(rest)
        payload = logfmt_message(t)
        return (
            F.when(
                t.rlike(VALKEY),
                pair(
                    F.regexp_extract(t, VALKEY, 7),
                    lookup(fixed.VALKEY_LEVELS, F.regexp_extract(t, VALKEY, 6)),
                ),
            )
            .when(t.rlike(APP_PIPE), pair(pipe, level))
            .when(payload.isNotNull(), pair(payload, logfmt_severity(t)))
            .otherwise(pair(t, default))
        )

    return let(col(c), read)


def parse_container_lines(
    lines: DataFrame,
    own_labels: tuple[str, ...] = (),
    source_ip: str = fixed.CONTAINER_SOURCE,
    source_alias: str | None = None,
    max_chars: int | None = fixed.MAX_TEXT_CHARS,
) -> DataFrame:
    """Lines (``value``, ``container_id``, ``container_name``, ``labels``, ``received_at``) as log
    rows without id, with ``truncated``: whether a text was cut to ``max_chars`` (None: never). Lines
    with neither time nor text are left out."""
    alias = source_alias or source_ip
    # An empty line has neither; testing the line itself keeps the parsing out of the filter
    staged = lines.filter(F.col("value") != "").withColumn("_p", container_ts("value"))
    staged = staged.withColumns({"_ts": F.col("_p.ts"), "_body": F.col("_p.rest")})
    staged = staged.withColumn("_m", container_message("_body", detect_severity("_body")))
    made = {
        "timestamp": normalize_ts(F.col("_ts"), F.col("received_at")),
        "received_at": F.col("received_at"),
        "source_ip": F.lit(source_ip),
        "source_alias": F.lit(alias),
        "app_name": display_name("labels", "container_name", "container_id", own_labels),
        "facility": F.lit(1),
        "severity": F.col("_m.severity"),
        "message": cap_text(clean_text("_m.message"), max_chars),
        "raw": cap_text(clean_text("_body"), max_chars),
        "truncated": longer_than(clean_text("_body"), max_chars),
    }
    kept = [c for c in lines.columns if c not in made and c not in ("value", "labels")]
    return staged.select(*kept, *[c.alias(n) for n, c in made.items()])
