"""Drop rules and alert rules applied to logs.

Rules are configuration: their rows are read once on the driver and become conditions, so the
logs are scanned without a join or shuffle. Rules are handled in slices, which keeps each
condition small enough for generated code whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import extract_ip
from ..functions.common import BLANKS
from ..functions.patterns import (
    META,
    exact_keys,
    glob_to_regex,
    is_wild,
    java_regex,
    split_list,
    trimmed,
    wildcard_match,
)

# Rules put into one condition.
SLICE = 50


def ordered_rules(rules: DataFrame) -> list[Row]:
    """Enabled rules in rule order."""
    return rules.filter("is_enabled").orderBy("display_order", "id").collect()


def _slices(rules: list[Row]):
    for i in range(0, len(rules), SLICE):
        yield rules[i : i + SLICE]


def _get(rule, name: str, default=None):
    value = rule[name] if name in rule else default
    return default if value is None else value


def _text_in(c: Column, low: str) -> Column:
    return F.coalesce(F.lower(c).contains(low), F.lit(False))


def alert_predicate(rule) -> Column:
    """Rows an alert rule matches: app list, severity, then the pattern in message or raw.

    A pattern with a metacharacter is a regular expression (any case); an invalid one never
    matches, unless a backslash alone made it one, which then counts as text.
    """
    cond = wildcard_match("app_name", _get(rule, "filter_app"))
    worst = _get(rule, "filter_severity")
    if worst is not None:
        cond = cond & (F.coalesce(F.col("severity"), F.lit(6)) <= worst)
    pattern = trimmed(_get(rule, "match_pattern"))
    if pattern in ("", "*"):
        return cond
    message, raw = F.col("message"), F.col("raw")
    regex = java_regex(pattern) if META & set(pattern) else None
    if regex is not None:
        return cond & F.coalesce(message.rlike(regex) | raw.rlike(regex), F.lit(False))
    if META & set(pattern) - {"\\"}:
        return F.lit(False)
    low = pattern.lower()
    return cond & (_text_in(message, low) | _text_in(raw, low))


def drop_predicate(rule) -> Column:
    """Rows a drop rule discards: host (alias or address), app, message pattern, and severity not
    worse than the threshold."""
    cond = F.lit(True)
    if split_list(_get(rule, "source_pattern")):
        names = _get(rule, "source_pattern")
        cond = cond & (wildcard_match("source_alias", names) | wildcard_match("source_ip", names))
    cond = cond & wildcard_match("app_name", _get(rule, "app_pattern"))
    least = _get(rule, "severity_threshold")
    if least is not None:
        cond = cond & F.coalesce(F.col("severity") >= least, F.lit(True))
    pattern = _get(rule, "message_pattern", "")
    if not pattern or pattern.strip(BLANKS) == "*":
        return cond
    message = F.col("message")
    if _get(rule, "is_regex", False):
        regex = java_regex(pattern)
        hit = F.lit(False) if regex is None else message.rlike(regex)
    elif is_wild(pattern):
        body = glob_to_regex("*" + pattern.strip(BLANKS).lower() + "*")
        hit = F.lower(message).rlike("(?s)^" + body + r"\z")
    else:
        hit = F.lower(message).contains(pattern.strip(BLANKS).lower())
    return cond & F.coalesce(hit, F.lit(False))


def first_match(rules: list[Row], predicate=drop_predicate) -> Column:
    """The id of the first rule that matches a row, or null; later rules are not evaluated."""
    parts = []
    for part in _slices(rules):
        chain = None
        for r in part:
            cond = predicate(r)
            chain = F.when(cond, F.lit(r["id"])) if chain is None else chain.when(cond, F.lit(r["id"]))
        parts.append(chain)
    return F.coalesce(*parts).cast("long") if parts else F.lit(None).cast("long")


def apply_drop_rules(logs: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    """The logs with ``drop_rule_id``, the first matching rule (null: the row is kept)."""
    listed = rules if isinstance(rules, list) else ordered_rules(rules)
    return logs.withColumn("drop_rule_id", first_match(listed))


def kept_logs(logs: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    return apply_drop_rules(logs, rules).filter("drop_rule_id IS NULL").drop("drop_rule_id")


def rule_drop_counts(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows dropped per rule, added to the rule's stored counter."""
    dropped = (
        apply_drop_rules(logs, rules)
        .filter("drop_rule_id IS NOT NULL")
        .groupBy(F.col("drop_rule_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("newly_dropped"))
    )
    fresh = F.coalesce("newly_dropped", F.lit(0))
    return rules.join(dropped, "id", "left").select(
        "id",
        "name",
        fresh.alias("newly_dropped"),
        (F.coalesce("dropped_count", F.lit(0)) + fresh).cast("long").alias("dropped_count"),
    )


def _hits(rules: list[Row], predicate) -> Column:
    return F.array_compact(F.array(*[F.when(predicate(r), F.lit(r["id"])) for r in rules]))


def match_rules(
    logs: DataFrame, rules: DataFrame | list[Row], predicate=alert_predicate, id_name: str = "rule_id"
) -> DataFrame:
    """One row per (log, matching rule)."""
    listed = rules if isinstance(rules, list) else ordered_rules(rules)
    if not listed:
        return logs.withColumn(id_name, F.lit(None).cast("long")).limit(0)
    found = F.concat(*[_hits(part, predicate) for part in _slices(listed)])
    return logs.withColumn(id_name, F.explode(found)).withColumn(id_name, F.col(id_name).cast("long"))


def match_alert_rules(logs: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    """One row per (log, matching alert rule). Rows flagged ``skip_alert_rules`` never match."""
    if "skip_alert_rules" in logs.columns:
        logs = logs.filter(~F.coalesce("skip_alert_rules", F.lit(False)))
    return match_rules(logs, rules)


def match_rules_indexed(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """The same result as ``match_alert_rules`` for many rules that name their apps exactly.

    Those rules are grouped by app into one condition per app, so a row meets only the rules of
    its own app and every pattern is compiled once. Rules with wildcards or without an app are
    evaluated on every row. No row moves.
    """
    listed = ordered_rules(rules)
    open_rules = [r for r in listed if not exact_keys(_get(r, "filter_app"))]
    by_app: dict[str, list[dict]] = {}
    for r in listed:
        for key in exact_keys(_get(r, "filter_app")) or ():
            by_app.setdefault(key, []).append(r.asDict() | {"filter_app": None})
    if "skip_alert_rules" in logs.columns:
        logs = logs.filter(~F.coalesce("skip_alert_rules", F.lit(False)))
    app = F.lower(F.btrim("app_name", F.lit(BLANKS)))
    keys = list(by_app)
    chains = []
    for i in range(0, len(keys), SLICE):
        chain = F
        for key in keys[i : i + SLICE]:
            own = F.concat(*[_hits(part, alert_predicate) for part in _slices(by_app[key])])
            chain = chain.when(app == key, own)
        chains.append(chain)
    found = [_hits(part, alert_predicate) for part in _slices(open_rules)]
    if chains:
        found.append(F.coalesce(*chains, F.array().cast("array<long>")))
    if not found:
        return logs.withColumn("rule_id", F.lit(None).cast("long")).limit(0)
    hits = F.explode(F.concat(*found) if len(found) > 1 else found[0])
    return logs.withColumn("rule_id", hits).withColumn("rule_id", F.col("rule_id").cast("long"))


def rule_coverage(logs: DataFrame, rules: DataFrame, predicate=alert_predicate) -> DataFrame:
    """For every rule: how many logs it matches, its first match and the address named there."""
    found = match_rules(logs, rules, predicate)
    first = F.min_by(F.struct("id", "message"), F.struct("timestamp", "id"))
    stats = found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("match_count"), first.alias("_first")
    )
    base = rules.filter("is_enabled").select(F.col("id").alias("rule_id"), "name")
    return base.join(stats, "rule_id", "left").select(
        "rule_id",
        "name",
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.col("_first.id").alias("sample_log_id"),
        F.col("_first.message").alias("sample"),
        extract_ip(F.col("_first.message")).alias("extracted_ip"),
    )
