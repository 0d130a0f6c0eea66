"""Hand-made rows."""

from __future__ import annotations

import datetime as dt

from logloom.schema import ALERT_RULES, DROP_RULES, LOGS

T0 = dt.datetime(2026, 3, 10, 12, 0, 0)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def log(id=1, seconds=0.0, **k) -> dict:
    row = dict(
        id=id, timestamp=at(seconds), received_at=at(seconds), source_ip="10.0.0.1", source_alias="web",
        app_name="nginx", facility=1, severity=6, message="hello", raw="hello",
    )
    row.update(k)
    return row


def logs(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in LOGS) for r in rows], LOGS)


def alert_rule(id=1, **k) -> tuple:
    row = dict(
        id=id, name=f"rule {id}", rule_type="threshold", channel_id=None, filter_app=None, filter_severity=None,
        match_pattern=None, threshold_count=1, window_seconds=60, cooldown_seconds=60, is_enabled=True,
        display_order=id,
    )
    row.update(k)
    return tuple(row[f.name] for f in ALERT_RULES)


def alert_rules(spark, *rules):
    return spark.createDataFrame(list(rules), ALERT_RULES)


def drop_rule(id=1, **k) -> tuple:
    row = dict(
        id=id, name=f"drop {id}", source_pattern=None, app_pattern=None, message_pattern=None, is_regex=False,
        is_enabled=True, severity_threshold=None, dropped_count=0, display_order=id,
    )
    row.update(k)
    return tuple(row[f.name] for f in DROP_RULES)


def drop_rules(spark, *rules):
    return spark.createDataFrame(list(rules), DROP_RULES)


def rows_moved(df) -> int:
    """The rows that the shuffles of a frame write when it runs."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    found, left = {}, [query.executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            left.append(node.plan())
        if node.metrics().contains("shuffleRecordsWritten"):
            metric = node.metrics().apply("shuffleRecordsWritten")
            found[metric.id()] = metric.value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found.values())
