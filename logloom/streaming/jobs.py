"""Stateless stream steps, windows over arrival time, and sinks that may be repeated."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import drop_replays
from ..operators.counts import ingest_rate
from ..operators.dims import resolve_alias
from ..operators.maintenance import maintenance_drops
from ..operators.ordered import numbered
from ..operators.rules import apply_drop_rules
from ..operators.textindex import BUCKET, build_postings, deal_postings, write_postings
from ..schema import BATCH, LOG_DEFAULTS, LOGS, conform, with_log_date
from ..session import join_dimension, stage, stage_scope
from ..sources.logs import write_days
from ..sources.stored import Folder, finish_changes
from ..sources.syslog import parse_syslog

Sink = Callable[[DataFrame, int], None]


def normalize_stream(
    lines: DataFrame, aliases: DataFrame, containers: list[str] = (), local_tz: str = "UTC"
) -> DataFrame:
    """Syslog lines parsed and named as they arrive."""
    return resolve_alias(parse_syslog(lines, local_tz=local_tz), aliases, list(containers))


def mark_stream(logs: DataFrame, drop_rules: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with the drop rule and maintenance session that discard them (null: kept).

    Rules come first; a row they drop is not counted for a session."""
    marked = maintenance_drops(apply_drop_rules(logs, drop_rules), sessions)
    return marked.withColumn(
        "session_id", F.when(F.col("drop_rule_id").isNull(), F.col("session_id"))
    )


def filter_stream(logs: DataFrame, drop_rules: DataFrame, sessions: DataFrame) -> DataFrame:
    """The rows that are stored."""
    marked = mark_stream(logs, drop_rules, sessions)
    return marked.filter("drop_rule_id IS NULL AND session_id IS NULL").drop("drop_rule_id", "session_id")


def filtered(sink: Sink, drop_rules: Callable[[], DataFrame], sessions: Callable[[], DataFrame]) -> Sink:
    """A sink of unfiltered rows that reads rules and sessions anew for every micro-batch, so that
    changes take effect while the stream runs."""
    return lambda batch, batch_id: sink(filter_stream(batch, drop_rules(), sessions()), batch_id)


def stream_ids(batch: DataFrame, batch_id: int, order: list[str] = ("received_at", "seq")) -> DataFrame:
    """``id`` in arrival order, ascending over batches and the same when a batch is repeated."""
    return numbered(batch, list(order), "id").withColumn("id", F.shiftleft(F.lit(batch_id).cast("long"), 40) + F.col("id"))


def append_batch(batch: DataFrame, batch_id: int, path: str, order: list[str] = ("received_at", "seq")) -> None:
    """Stores a micro-batch of log rows by day, in the layout that ``append_logs`` writes.

    A repeated batch replaces its first attempt, so every row is stored once; on days where the first
    attempt was changed since (rows deleted, pruned, backfilled or merged), the change stays. ``compact_days``
    merges the batches of closed days."""
    rows = batch if "id" in batch.columns else stream_ids(batch, batch_id, list(order))
    rows = with_log_date(conform(rows, LOGS, LOG_DEFAULTS))
    settled = finish_changes(batch.sparkSession, path).settled(batch_id)
    if settled:
        rows = rows.filter(~F.col("log_date").isin(*settled))
    write_days(rows, path, batch_id, "overwrite", tasks=4)


def index_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = 256, by_day: bool = False) -> None:
    """Adds the words of a micro-batch to the index. A repeated batch replaces its first attempt."""
    day = ["log_date"] if by_day else []
    (
        deal_postings(build_postings(batch, by_day), buckets)
        .withColumn(BATCH, F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*day, BUCKET, BATCH)
        .parquet(path)
    )


def compact_index(spark: SparkSession, path: str, out: str) -> None:
    """The index written anew to ``out`` with one batch per bucket."""
    write_postings(spark.read.parquet(path).drop(BUCKET, BATCH), out)


def fan_out(*sinks: Sink) -> Sink:
    """One sink that hands a micro-batch to several, in order. The batch is written once to the shared
    folder, so all of them get the same rows, also when executors are lost in between."""

    def all_sinks(batch: DataFrame, batch_id: int) -> None:
        with stage_scope():
            rows = stage(batch, "fan-out")
            for sink in sinks:
                sink(rows, batch_id)

    return all_sinks


def start(
    stream: DataFrame, sink: Sink, checkpoint: str, name: str | None = None, **trigger
) -> StreamingQuery:
    """Starts a query whose progress is kept in ``checkpoint`` (on shared storage)."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def store_stream(logs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stores the rows of a stream by day."""
    return start(logs, lambda b, i: append_batch(b, i, path), checkpoint, **trigger)


def drop_replays_stream(
    lines: DataFrame, keys: tuple[str, ...] = ("container_id", "ts", "message"), ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Lines without those delivered again within the delay."""
    return lines.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def without_replays(
    sink: Sink, state_path: str, key: str = "container_id", ts: str = "ts", order: str = "seq"
) -> Sink:
    """A sink of lines as they arrive that hands on no line which a reconnect delivered again, however old:
    none older than the newest line handed on of its ``key``, and none equal to one of that time.

    ``drop_replays`` over micro-batches: per key, the newest time and the hashes of its lines at that time
    are kept in ``state_path``, one small table per batch, so a repeated batch starts from the state before it.
    """

    line = F.xxhash64("message")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = Folder(spark, state_path)
        numbers = sorted(int(n.split("=")[1]) for n in known.names() if n.startswith(f"{BATCH}="))
        earlier = [n for n in numbers if n < batch_id]
        kinds = dict(batch.dtypes)
        state = spark.createDataFrame([], f"{key} {kinds[key]}, newest {kinds[ts]}, lines array<long>")
        if earlier:
            state = spark.read.schema(state.schema).parquet(f"{state_path}/{BATCH}={earlier[-1]}")
        lines = stage(batch, "replays-in")  # a source may give other rows when it is read again
        met = join_dimension(lines, state, [key]).filter(
            F.col(ts).isNull() | F.col("newest").isNull() | (F.col(ts) > F.col("newest"))
            | ((F.col(ts) == F.col("newest")) & ~F.array_contains("lines", line))
        )
        fresh = stage(drop_replays(met.select(*lines.columns), key, ts, order), "replays-out")
        newest = fresh.filter(F.col(ts).isNotNull()).groupBy(key).agg(F.max(ts).alias("newest"))
        ends = join_dimension(fresh, newest, [key], "inner").filter(F.col(ts) == F.col("newest"))
        now = ends.groupBy(key, "newest").agg(F.collect_set(line).alias("lines"))
        both = state.unionByName(now).groupBy(key).agg(
            F.max("newest").alias("newest"), F.collect_list(F.struct("newest", "lines")).alias("all")
        )
        at_newest = F.filter("all", lambda x: x["newest"] == F.col("newest"))
        both.select(key, "newest", F.array_distinct(F.flatten(F.transform(at_newest, lambda x: x["lines"]))).alias("lines")).write.mode(
            "overwrite"
        ).parquet(f"{state_path}/{BATCH}={batch_id}")
        for old in earlier[:-1]:
            known.remove(f"{BATCH}={old}")
        sink(fresh, batch_id)

    return each


def late_rows_beside(sink: Sink, late_path: str, mark_path: str, ts: str = "timestamp", delay_seconds: int = 10) -> Sink:
    """A sink that hands on the rows a watermark of ``delay_seconds`` lets pass, and stores the others.

    The mark is the newest ``ts`` of the batches before, less the delay, as Spark's watermark is; rows behind it
    go to ``late_path`` by batch, where they can be counted. A repeated batch replaces its late rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbers = sorted(int(n.split("=")[1]) for n in Folder(spark, mark_path).names() if n.startswith(f"{BATCH}="))
        earlier = [n for n in numbers if n < batch_id]
        mark = None
        if earlier:
            mark = spark.read.schema("newest long").parquet(f"{mark_path}/{BATCH}={earlier[-1]}").first()[0]
        rows = stage(batch, "timed-in")
        behind = F.lit(False) if mark is None else F.coalesce(F.unix_micros(ts) < mark - delay_seconds * 1_000_000, F.lit(False))
        rows.filter(behind).write.mode("overwrite").parquet(f"{late_path}/{BATCH}={batch_id}")
        top = rows.agg(F.max(F.unix_micros(ts)).alias("newest"))
        top.select(F.greatest("newest", F.lit(mark).cast("long")).alias("newest")).write.mode("overwrite").parquet(f"{mark_path}/{BATCH}={batch_id}")
        for old in earlier[:-1]:
            Folder(spark, mark_path).remove(f"{BATCH}={old}")
        sink(rows.filter(~behind), batch_id)

    return each


def rate_stream(logs: DataFrame, seconds: int = 5, slide: int = 1, delay: str = "10 seconds") -> DataFrame:
    """Rows per second over a rolling window of arrival time."""
    return ingest_rate(logs.withWatermark("received_at", delay), seconds, slide)


def tail_stream(
    logs: DataFrame, condition: Column, sink: Sink, checkpoint: str, max_events: int | None = None, **trigger
) -> StreamingQuery:
    """Hands the rows under a filter to ``sink`` as they arrive; ends after ``max_events``."""
    count_path = f"{checkpoint.rstrip('/')}-events"
    running: list[StreamingQuery] = []

    def counted(batch: DataFrame, batch_id: int) -> None:
        if max_events is None:
            return sink(batch, batch_id)
        spark = batch.sparkSession
        # What earlier batches handed on is kept beside the checkpoint, one row per batch
        seen = _handed_on(spark, count_path, batch_id)
        if seen < max_events:
            with stage_scope():
                part = stage(batch.orderBy("received_at", "id").limit(max_events - seen), "tail")
                sink(part, batch_id)
                taken = part.count()
            spark.createDataFrame([(taken,)], "taken long").coalesce(1).write.mode(
                "overwrite"
            ).parquet(f"{count_path}/{BATCH}={batch_id}")
            seen += taken
        if seen >= max_events and running:
            # From another thread: a query cannot wait for its own end
            threading.Thread(target=running[0].stop, daemon=True).start()

    query = start(logs.filter(condition), counted, checkpoint, **trigger)
    running.append(query)
    return query


def _handed_on(spark: SparkSession, path: str, batch_id: int) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
        return 0
    earlier = spark.read.schema(f"taken long, {BATCH} long").parquet(path).filter(F.col(BATCH) < batch_id)
    return earlier.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
