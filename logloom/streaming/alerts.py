"""Alert rules over a stream, with the same firings as over stored logs.

The stream is reduced to one count per rule and second before any state is kept, so a log storm
reaches a rule's state as one row per second. Event time decides: a second counts once the
watermark has passed it, and rows that come later than the watermark allows are not counted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..operators.alerts import SEGMENTS, Fold, incidents_of, of_firing_days, per_second, rule_settings
from ..operators.rules import match_alert_rules, ordered_rules
from ..schema import BATCH, LOGS, with_log_date
from ..session import stage
from ..sources.stored import Folder

_NAMES = [f.split()[0] for f in SEGMENTS.split(", ")]


def clamp_event_time(logs: DataFrame) -> DataFrame:
    """Event times kept between a day before and 300 s after the arrival."""
    arrived = F.unix_micros("received_at")
    low = arrived - fixed.MAX_PAST_SECONDS * 1_000_000
    high = arrived + fixed.MAX_FUTURE_SECONDS * 1_000_000
    us = F.least(F.greatest(F.unix_micros("timestamp"), low), high)
    return logs.withColumn("timestamp", F.timestamp_micros(us))


class RuleWindow(StatefulProcessor):
    """A rule's window and cooldown in keyed state, fed with its counts per second."""

    def __init__(self, settings: dict[int, tuple[int, int, int]]):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "held binary, total long, quiet_until long")

    def load(self, rule_id: int) -> Fold:
        fold = Fold(*self.settings[rule_id])
        if self.state.exists():
            held, total, quiet = self.state.get()
            rows = np.frombuffer(bytes(held), dtype=np.int64).reshape(-1, 3)
            fold.held = deque(tuple(r) for r in rows.tolist())
            fold.total, fold.quiet_until = total, quiet
        return fold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule_id = key[0]
        counts = pd.concat(list(rows)).sort_values("sec")
        fold, out = self.load(rule_id), []
        for sec, n in zip(counts["sec"].tolist(), counts["n"].tolist()):
            fired = fold.add(sec, n)
            if fired:
                members, first, firings = fired
                out += [(rule_id, s, sec, used, None, None, None, total) for s, used, total in members]
                out.append((rule_id, sec, sec, 0, first, fold.needed, firings, n))
        held = np.array(list(fold.held), dtype=np.int64).tobytes()
        self.state.update((held, fold.total, fold.quiet_until))
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype("Int64")

    def close(self) -> None:
        pass


def alert_segments(logs: DataFrame, rules: DataFrame | list[Row], delay: str = "10 seconds") -> DataFrame:
    """The firings of pattern, threshold and rate rules over a stream, in the form that
    ``apply_cooldown`` gives for stored logs.

    Needs the RocksDB state store provider.
    """
    listed = rules if isinstance(rules, list) else ordered_rules(rules)
    matches = match_alert_rules(logs.withWatermark("timestamp", delay), listed)
    counts = (
        matches.groupBy("rule_id", F.window("timestamp", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("rule_id", F.unix_seconds("w.start").alias("sec"), "n")
    )
    return counts.groupBy("rule_id").transformWithStateInPandas(
        RuleWindow(rule_settings(listed)), SEGMENTS, "Append", "None"
    )


def write_alerts(
    spark: SparkSession, segments: DataFrame, batch_id: int, logs_path: str, rules: DataFrame, out: str,
    lag_seconds: float = 10.0, final: bool = False,
) -> None:
    """Sink of ``alert_segments``: incidents with sample, culprits and summary, from the stored rows.

    Another query stores the rows and may be behind. Firings are kept open beside the incidents; each batch
    completes those whose counted matches are all stored, and those that the store has passed: it
    holds a row more than ``lag_seconds`` later, so what is missing was dropped, salvaged or deleted, and
    the incident says how many (``missing``). The sink never waits; ``final`` completes all that is open.
    A repeated batch replaces its incidents. Only the days of open firings are read.
    """
    opened = f"{out.rstrip('/')}/_open"
    segments.write.mode("overwrite").parquet(f"{opened}/{BATCH}={batch_id}")
    kept = spark.read.schema(f"{SEGMENTS}, {BATCH} long").parquet(opened).filter(F.col(BATCH) <= batch_id)
    done = _completed(spark, out, batch_id)
    waiting = stage(kept.join(done, ["rule_id", "fire_sec"], "left_anti"), "open-firings")
    _forget_completed(spark, opened, waiting, batch_id)
    if waiting.isEmpty():
        return
    logs = of_firing_days(_stored(spark, logs_path), waiting)
    matches = match_alert_rules(logs, rules)
    have = per_second(matches)
    whole = waiting.join(have, ["rule_id", "sec"], "left").groupBy("rule_id", "fire_sec").agg(
        F.min(F.coalesce("n", F.lit(0)) >= F.col("matches")).alias("_whole")
    )
    passed = F.lit(final) | (F.col("fire_sec") + lag_seconds < F.lit(_newest_second(spark, logs_path)))
    ready = stage(
        waiting.join(whole.filter(F.col("_whole") | F.coalesce(passed, F.lit(False))), ["rule_id", "fire_sec"], "left_semi")
        .drop(BATCH), "ready-firings",
    )
    incidents = incidents_of(matches, ready, rules).withColumn("fire_sec", F.unix_seconds("triggered_at"))
    incidents.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{BATCH}={batch_id}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; none before the first batch of the store."""
    if Folder(spark, path).days():
        return spark.read.parquet(path)
    return with_log_date(spark.createDataFrame([], LOGS))


def _newest_second(spark: SparkSession, path: str) -> int | None:
    """The newest event second of the store, from its last day."""
    days = Folder(spark, path).days()
    if not days:
        return None
    last = spark.read.parquet(path).filter(F.col("log_date") == F.lit(days[-1]))
    return last.agg(F.max(F.unix_seconds("timestamp"))).first()[0]


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split("=")[1]) for n in Folder(spark, path).names() if n.startswith(f"{BATCH}=")]


def _completed(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Firings whose incidents earlier batches wrote."""
    schema = "rule_id long, fire_sec long"
    earlier = [b for b in _batches(spark, out) if b < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out.rstrip('/')}/{BATCH}={b}" for b in earlier]).distinct()


def _forget_completed(spark: SparkSession, opened: str, waiting: DataFrame, batch_id: int) -> None:
    """Removes the open firings of earlier batches that have none left."""
    left = {r[0] for r in waiting.select(BATCH).distinct().collect()}
    for b in _batches(spark, opened):
        if b < batch_id and b not in left:
            Folder(spark, opened).remove(f"{BATCH}={b}")
