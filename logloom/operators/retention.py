"""Deleting, pruning and their previews.

Tables are immutable files: a delete is the frame of kept rows. ``rewrite_days`` writes it back
for the batches that lost rows, and no others; deletes, pruning and backfills of stored tables use it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import BATCH, own_batch
from ..session import join_dimension, stage
from ..sources.logs import write_days
from ..sources.stored import PAIRS, Folder, Pair, finish_changes
from .filters import LogFilter, log_filter, resolve_bound
from .incidents import history_kind

METRICS_DAYS = 30


def kept_rows(df: DataFrame, cond: Column) -> DataFrame:
    """The rows a delete leaves; a condition that is null deletes nothing."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def count_rows(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(cond).agg(F.count(F.lit(1)).alias("deleted"))


def delete_condition(spec: LogFilter, delete_all: bool = False) -> Column:
    if spec.is_empty() and not delete_all:
        raise ValueError("a delete needs a criterion, or delete_all=True")
    return log_filter(spec)


def delete_logs(
    logs: DataFrame, spec: LogFilter, delete_all: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and the number of deleted ones."""
    cond = delete_condition(spec, delete_all)
    return kept_rows(logs, cond), count_rows(logs, cond)


def delete_by_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    return join_dimension(logs, ids.toDF("id").distinct(), ["id"], "left_anti")


def delete_all(logs: DataFrame, max_id: int) -> DataFrame:
    """Everything up to the highest id at the start goes; later rows stay."""
    return logs.filter(F.col("id") > max_id)


def cutoff_of(as_of: dt.datetime, retention_days: int) -> dt.datetime:
    return as_of - dt.timedelta(days=max(1, retention_days))


def prune_logs(logs: DataFrame, retention_days: int, as_of: dt.datetime) -> DataFrame:
    """Rows younger than the retention. With a ``log_date`` column older days are never read."""
    cutoff = cutoff_of(as_of, retention_days)
    kept = F.col("timestamp") >= F.lit(cutoff)
    if "log_date" in logs.columns:
        kept = kept & (F.col("log_date") >= F.lit(cutoff.date()))
    return logs.filter(kept)


def _with_expiry(incidents: DataFrame, sessions: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """History rows with ``expired``.

    Ordinary rows go by their own time, maintenance rows by the end of their session; a session
    that still runs keeps its rows, an unknown session counts by the row's own time.
    """
    s = sessions.select(
        F.col("session_id").alias("maintenance_session_id"),
        "is_active", "ended_at", F.lit(True).alias("_known"),
    )
    limit = F.lit(cutoff)
    own = F.col("triggered_at") < limit
    ended = ~F.col("is_active") & F.col("ended_at").isNotNull() & (F.col("ended_at") < limit)
    expired = F.when(F.col("_known").isNull(), own).otherwise(ended)
    return (
        incidents.join(s, "maintenance_session_id", "left")
        .withColumn("expired", F.coalesce(expired, F.lit(False)))
        .select(*incidents.columns, "expired")
    )


def prune_history(incidents: DataFrame, sessions: DataFrame, cutoff: dt.datetime) -> DataFrame:
    return _with_expiry(incidents, sessions, cutoff).filter("NOT expired").drop("expired")


def prune_sessions(sessions: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Sessions without those that ended before the cutoff."""
    gone = ~F.col("is_active") & (F.col("ended_at") < F.lit(cutoff))
    return kept_rows(sessions, gone)


def _referenced(incidents: DataFrame) -> DataFrame:
    return incidents.filter("ai_audit_id IS NOT NULL").select(F.col("ai_audit_id").alias("id")).distinct()


def orphan_audits(audits: DataFrame, incidents: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Analysis rows older than the cutoff that no history row names."""
    return audits.filter(F.col("timestamp") < F.lit(cutoff)).join(
        _referenced(incidents), "id", "left_anti"
    )


def linked_audits(
    audits: DataFrame, incidents: DataFrame, sessions: DataFrame, cutoff: dt.datetime
) -> DataFrame:
    """Analysis rows of expired history rows that no kept row names."""
    marked = _with_expiry(incidents, sessions, cutoff)
    return audits.join(_referenced(marked.filter("expired")), "id", "left_semi").join(
        _referenced(marked.filter("NOT expired")), "id", "left_anti"
    )


def removed_audits(
    audits: DataFrame, incidents: DataFrame, sessions: DataFrame, cutoff: dt.datetime
) -> DataFrame:
    """Linked and orphan audits; no row is in both."""
    return linked_audits(audits, incidents, sessions, cutoff).unionByName(
        orphan_audits(audits, incidents, cutoff)
    )


def prune_audits(
    audits: DataFrame,
    messages: DataFrame,
    incidents: DataFrame,
    sessions: DataFrame,
    cutoff: dt.datetime,
) -> tuple[DataFrame, DataFrame]:
    """The kept audits, and the kept messages of their threads."""
    gone = removed_audits(audits, incidents, sessions, cutoff).select("id").distinct()
    kept = audits.join(gone, "id", "left_anti")
    kept_messages = messages.join(gone.withColumnRenamed("id", "audit_id"), "audit_id", "left_anti")
    return kept, kept_messages


def prune_metrics(metrics: DataFrame, as_of: dt.datetime, days: int = METRICS_DAYS) -> DataFrame:
    return metrics.filter(F.col("recorded_at") >= F.lit(as_of - dt.timedelta(days=days)))


def prune_preview(
    logs: DataFrame,
    incidents: DataFrame,
    sessions: DataFrame,
    audits: DataFrame,
    metrics: DataFrame,
    retention_days: int,
    as_of: dt.datetime,
) -> DataFrame:
    """What a prune would remove, per kind and in total (one row)."""
    cutoff = cutoff_of(as_of, retention_days)
    n = F.count(F.lit(1)).alias("n")
    parts = [
        logs.filter(F.col("timestamp") < F.lit(cutoff)).agg(n).select(F.lit("logs").alias("kind"), "n"),
        metrics.filter(F.col("recorded_at") < F.lit(as_of - dt.timedelta(days=METRICS_DAYS)))
        .agg(n).select(F.lit("metrics").alias("kind"), "n"),
        removed_audits(audits, incidents, sessions, cutoff)
        .agg(n).select(F.lit("ai_audit").alias("kind"), "n"),
        _with_expiry(incidents, sessions, cutoff).filter("expired")
        .groupBy(F.concat(F.lit("history_"), history_kind()).alias("kind")).agg(n),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kinds = ("logs", "history_alert", "history_on_demand", "history_digest",
             "history_maintenance", "metrics", "ai_audit")
    sums = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in kinds}
    history = F.coalesce(F.sum(F.when(F.col("kind").startswith("history_"), F.col("n"))), F.lit(0))
    return rows.agg(
        *[c.alias(k) for k, c in sums.items()], history.alias("history_total"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


Change = Callable[[DataFrame], DataFrame]


def rewrite_days(
    spark: SparkSession, path: str, touched: Change, change: Change,
    first: dt.date | None = None, last: dt.date | None = None,
) -> dict[str, int]:
    """Changes rows of a stored table; only the batches that hold such rows are written again.

    ``touched`` gives the rows that the change concerns, ``change`` the rows of a batch after it.
    Only the days from ``first`` to ``last`` are opened. Rows keep their batch, the layout and the order by
    host and time; a batch without rows goes, and so does a day. A micro-batch of a stream that is
    repeated afterwards is recognised, so the table stays as the change left it. Batches that are added
    meanwhile stay as they are; one that is replaced meanwhile stops the change before
    anything is swapped. A change that was stopped half way is completed by the next writer. More
    than ``stored.PAIRS`` batches are changed one part after the other.
    """
    files = finish_changes(spark, path)
    days = [d for d in files.days() if (not first or d >= first) and (not last or d <= last)]
    if not days:
        return {"touched": 0, "days_rewritten": 0, "days_removed": 0}
    table = spark.read.parquet(path)
    if first or last:
        table = table.filter(F.col("log_date").between(F.lit(days[0]), F.lit(days[-1])))
    hit = touched(table).groupBy("log_date", BATCH).agg(F.count(F.lit(1)).alias("n")).collect()
    pairs = sorted((r["log_date"], r[BATCH]) for r in hit)
    for at in range(0, len(pairs), PAIRS):
        _replace(spark, files, pairs[at : at + PAIRS], change, table.schema)
    return _outcome(files, {d for d, _ in pairs}, sum(r["n"] for r in hit))


def _outcome(files: Folder, days: set[dt.date], touched: int) -> dict[str, int]:
    left = set(files.days())
    return {"touched": touched, "days_rewritten": len(days & left), "days_removed": len(days - left)}


def _replace(spark: SparkSession, files: Folder, pairs: list[Pair], change: Change, schema: T.StructType, batch: int | None = None) -> None:
    """Replaces exactly the files that some (day, batch) pairs hold now; ``batch`` merges them into one."""
    before = {pair: files.files(pair) for pair in pairs}
    listed = [p for pair, found in before.items() for p in files.paths(pair, list(found))]
    stored = spark.read.schema(schema).option("basePath", files.root).parquet(*listed)
    number = files.new_change()
    rows = change(stored).select(stored.columns)
    write_days(rows, files.staging(number), batch)
    if any(files.files(pair) != found for pair, found in before.items()):
        files.discard(number)
        raise RuntimeError("rows were added to a batch while it was changed; nothing was changed, run it again")
    files.commit(number, {pair: list(found) for pair, found in before.items()})
    files.finish(number)


def compact_days(spark: SparkSession, path: str, last: dt.date, min_batches: int = 2) -> int:
    """Merges the batches of every day up to ``last`` that has at least ``min_batches``; returns
    the number of days. For days to which nothing is added any more."""
    files = finish_changes(spark, path)
    many = {d: found for d in files.days() if d <= last and len(found := files.batches(d)) >= min_batches}
    schema = spark.read.parquet(path).schema if many else None
    for day, batches in many.items():
        _replace(spark, files, [(day, b) for b in batches], lambda rows: rows, schema, own_batch())
    return len(many)


def delete_stored(spark: SparkSession, path: str, spec: LogFilter, delete_all: bool = False) -> dict[str, int]:
    """Deletes the rows of a filter from a stored table; its time bounds limit the days opened."""
    cond = F.coalesce(delete_condition(spec, delete_all), F.lit(False))
    as_of = spec.as_of or dt.datetime.now(dt.timezone.utc)
    low, high = (resolve_bound(x, as_of, spec.tz) for x in (spec.start, spec.end))
    return rewrite_days(
        spark, path, lambda rows: rows.filter(cond), lambda rows: rows.filter(~cond),
        low.date() if low else None, high.date() if high else None,
    )


def delete_stored_ids(spark: SparkSession, path: str, ids: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> dict[str, int]:
    """Deletes rows by id from a stored table."""
    ids = stage(ids.toDF("id").distinct(), "ids")
    return rewrite_days(
        spark, path, lambda rows: join_dimension(rows, ids, ["id"], "left_semi"), lambda rows: delete_by_ids(rows, ids), first, last
    )


def prune_stored(spark: SparkSession, path: str, retention_days: int, as_of: dt.datetime) -> dict[str, int]:
    """Removes rows older than the retention: older days go as folders without being read, and only
    the day of the cutoff is written again."""
    cutoff = cutoff_of(as_of, retention_days)
    files = finish_changes(spark, path)
    gone = [day for day in files.days() if day < cutoff.date()]
    for day in gone:
        number = files.new_change()
        files.commit(number, {(day, b): list(files.files((day, b))) for b in files.batches(day)})
        files.finish(number)
    old = F.col("timestamp") < F.lit(cutoff)
    edge = {"days_rewritten": 0, "days_removed": 0}
    if cutoff.date() in files.days():
        edge = rewrite_days(spark, path, lambda rows: rows.filter(old), lambda rows: rows.filter(~old), cutoff.date(), cutoff.date())
    return {"days_removed": len(gone) + edge["days_removed"], "days_rewritten": edge["days_rewritten"]}


def backfill_stored(spark: SparkSession, path: str, column: str, change: Change, first: dt.date | None = None, last: dt.date | None = None) -> dict[str, int]:
    """Rewrites the days on which ``change`` gives ``column`` another value, as ``backfill_alias``
    (``source_alias``) and ``backfill_app`` (``app_name``) do."""
    before = "_before"

    def touched(rows: DataFrame) -> DataFrame:
        return change(rows.withColumn(before, F.col(column))).filter(~F.col(before).eqNullSafe(F.col(column)))

    return rewrite_days(spark, path, touched, change, first, last)
